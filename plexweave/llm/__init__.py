"""Operators for training-data pipelines: one module for each, plus their queries."""
