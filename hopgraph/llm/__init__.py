"""Operators of a training-data pipeline: documents in, documents or per-document facts out."""
