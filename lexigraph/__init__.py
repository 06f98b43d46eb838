"""Concept-graph analytics and retrieval over text corpora, on Spark."""
