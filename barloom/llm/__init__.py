"""Operators of a training-data pipeline: documents, pages and vectors in, DataFrames out."""
