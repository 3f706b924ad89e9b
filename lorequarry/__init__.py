"""Spark-native literature retrieval and knowledge-graph analytics."""
