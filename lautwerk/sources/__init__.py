"""Readers of name records."""
