"""Scalar functions on names, as column expressions."""
