"""Spark-native analytics for auditing text corpora and membership scores."""
