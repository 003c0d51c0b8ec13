"""Operators for training-data pipelines over documents, pages and benchmarks.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
