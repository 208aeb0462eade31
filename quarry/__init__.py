"""Spark-native document retrieval, catalog and corpus analytics."""
