"""Spark-native analytics over governed document corpora and the graphs derived from them."""
