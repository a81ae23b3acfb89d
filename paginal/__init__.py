"""Spark-native full-text search and training-data processing."""
