"""Spark-native engine for rich-text documents and training-data corpora."""
