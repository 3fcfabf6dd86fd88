"""Incremental work: skip what has already been produced."""
