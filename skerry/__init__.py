"""Skerry: hybrid retrieval and ranking analytics expressed as Spark DataFrame plans."""
