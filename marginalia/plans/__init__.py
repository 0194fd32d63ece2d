"""Marginalia plans."""
