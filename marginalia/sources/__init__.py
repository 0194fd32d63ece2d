"""Marginalia sources."""
