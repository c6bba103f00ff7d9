"""Operators on tables of records, names and matches."""
