"""Spark-native analytics for event venues and retail booths."""
