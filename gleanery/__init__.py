"""Gleanery: retrieval, evaluation and text-collection operators as Spark DataFrame transformations."""
