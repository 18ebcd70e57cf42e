"""Spark-native preparation of text corpora for narration."""
