"""Spark-native document-evidence engine."""
