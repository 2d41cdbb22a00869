"""Operators for large training-text corpora, each one a Spark job over a documents table."""
