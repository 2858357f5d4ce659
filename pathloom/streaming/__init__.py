"""Incremental work that survives an interruption."""
