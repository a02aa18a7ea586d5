"""Corpus preparation, retrieval, grounding, evaluation and operational analytics as Spark DataFrame operators."""
