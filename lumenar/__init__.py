"""Spark-native engine for querying text collections as relational tables."""
