"""Spark-native analytics over spoken-note event streams, transcripts and drafts."""

__version__ = "0.1.0"
