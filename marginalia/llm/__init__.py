"""Operators for training data: truncation, unification, overlap, defects, packing, leakage and reading level.

Nothing outside this subpackage imports it.
"""
