"""Spark-native document matching, scheduling and list-building analytics."""
