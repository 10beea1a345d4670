"""Spark-native ranking, text-evidence and data-processing operators."""
