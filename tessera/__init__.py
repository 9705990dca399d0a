"""Spark-native Bayesian co-clustering of large matrices."""
