"""Spark-native analytics over variant, ontology and literature relations."""

__version__ = "0.1.0"
