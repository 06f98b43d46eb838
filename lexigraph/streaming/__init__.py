"""Incremental upkeep of the graph's tables."""
