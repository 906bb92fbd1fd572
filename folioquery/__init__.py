"""Spark-native hybrid retrieval and document analytics."""
