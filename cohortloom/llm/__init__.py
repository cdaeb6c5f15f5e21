"""Operators for large-scale text corpora (training-data pipelines). Nothing else in the library imports this."""
