"""Spark-native text retrieval, relational and streaming analytics."""
