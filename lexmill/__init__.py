"""Spark-native analytics over documents, model answers and judgments."""
