"""Corpus-evidence analytics on Spark."""
