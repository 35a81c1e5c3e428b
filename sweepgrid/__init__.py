"""Spark-native point-cloud grid analytics."""
