"""Spark-native analytics over citation-rich document corpora."""
