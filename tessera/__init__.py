"""Spark-native retrieval, ranking and conversation analytics."""
