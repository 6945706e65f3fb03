"""Spark-native analytics for scanned-document batches."""
