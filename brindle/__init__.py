"""Spark-native engine for content-addressed signal datasets."""
