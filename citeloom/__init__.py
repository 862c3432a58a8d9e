"""Spark-native cited retrieval, evaluation analytics and training-data preparation."""
