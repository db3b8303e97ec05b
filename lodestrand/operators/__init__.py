"""Operators over DataFrames: chunking, lexical and vector search, fusion, manifests."""
