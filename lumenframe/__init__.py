"""Spark-native analytics for media libraries and text corpora."""
