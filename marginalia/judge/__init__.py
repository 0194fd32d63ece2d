"""Marginalia judge."""
