"""Operators over DataFrames: relational, chunking, tables, retrieval, usage, mutation."""
