"""Corpus analytics on Spark: relational tables, vectors, clustering and incremental runs."""

__version__ = "0.1.0"
