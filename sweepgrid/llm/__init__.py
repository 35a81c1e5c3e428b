"""Operators for training-data pipelines over the document and page tables."""
