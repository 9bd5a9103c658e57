"""Scalar functions as column expressions: text, tables, time, vectors."""
