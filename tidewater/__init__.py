"""Spark-native analytics for transcripts, event streams, intervals and embeddings."""
