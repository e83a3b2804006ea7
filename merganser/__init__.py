"""Spark-native novelty analytics."""
