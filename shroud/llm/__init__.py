"""Operators and pipeline for building training data from large corpora."""
