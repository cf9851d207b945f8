"""Spark-native table, log, retrieval, usage and trace analytics."""
