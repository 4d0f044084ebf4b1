"""Spark-native feedback analytics."""
