"""Spark-native analytics for time-domain photometry tables."""
