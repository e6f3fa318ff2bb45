"""Spark-native cross-tab (pivot) analytics."""
