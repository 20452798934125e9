"""Spark-native indexed text search."""
