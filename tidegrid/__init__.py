"""Spark-native analytics of multi-channel time series and of text corpora."""
