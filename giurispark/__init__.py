"""Spark-native analytics for evaluating question answering on case law."""
