"""Spark-native analytics for financial research data."""
