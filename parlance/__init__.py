"""Spark-native analysis of political rhetoric: sentences, features, labels, scores."""
