"""Spark-native analytics over time-stamped news, macro events and corpora."""
