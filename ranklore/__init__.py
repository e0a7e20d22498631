"""Spark-native learned indexing, vector analytics and corpus preparation."""
