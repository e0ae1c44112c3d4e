"""Spark-native panel, relative-value and training-data analytics."""
