"""Spark-native analytics for tiled images, feature tables and training corpora."""
