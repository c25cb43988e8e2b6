"""Spark-native gradient-boosted trees, and operators for training data."""
