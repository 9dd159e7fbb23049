"""Operators for building training corpora: every one runs as Spark jobs over whole tables."""
