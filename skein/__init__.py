"""Spark-native analytics over conversation memory."""
