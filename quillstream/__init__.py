"""Spark-native operators for text-expression discovery and leakage-safe dataset preparation."""
