"""Spark-native retrieval, audit and corpus-quality engine."""
