"""Marginalia operators."""
