"""Marginalia streaming."""
