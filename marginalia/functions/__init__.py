"""Marginalia functions."""
