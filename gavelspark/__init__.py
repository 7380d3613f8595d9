"""Spark-native auction analytics."""
