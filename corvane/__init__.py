"""Spark jobs for listing record tables and for preparing text corpora."""
