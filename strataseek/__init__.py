"""Spark-native retrieval and corpus analytics."""
