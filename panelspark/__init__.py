"""Spark-native analytics for panels of securities."""
