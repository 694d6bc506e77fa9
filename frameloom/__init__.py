"""Spark-native analytics over time-ordered frame data."""
