"""Corpus style analytics on PySpark."""
