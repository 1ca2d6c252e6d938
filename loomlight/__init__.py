"""loomlight: a Spark-native engine that shrinks, indexes and measures the text language models read."""
