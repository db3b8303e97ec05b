"""Whole queries: indexing and hybrid search."""
