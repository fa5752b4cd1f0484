"""Spark-native time-to-event analytics over wide, multi-source tables."""
