"""Column builders, and the few helpers that run inside Python tasks."""
