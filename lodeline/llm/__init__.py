"""Operators for large training-data pipelines. Nothing outside this folder imports it."""
