"""Structured Streaming forms of the reply operators."""
