"""Operators for training-data pipelines: documents, vectors, pages and their outputs."""
