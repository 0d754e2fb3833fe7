"""Whole jobs made of the operators, and the shared physical helpers."""
