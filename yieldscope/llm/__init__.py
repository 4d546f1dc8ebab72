"""Operators over text and vector corpora for training-data pipelines, and their queries."""
