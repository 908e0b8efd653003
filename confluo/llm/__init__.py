"""Corpus operators for training-data pipelines. Nothing else in confluo imports this package."""
