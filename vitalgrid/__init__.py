"""Spark-native analytics for large collections of wearable-sensor recordings."""
