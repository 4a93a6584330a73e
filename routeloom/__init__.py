"""Spark-native analytics for transit networks."""
