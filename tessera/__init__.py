"""Tessera: a Spark-native analytics engine for text, transcript and signal collections."""
