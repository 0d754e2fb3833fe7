"""Operators for preparing training text: filters, near-duplicates, mixing, formatting, output files."""
