"""Indexing as files arrive."""
