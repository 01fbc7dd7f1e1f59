"""Spark-native analytics over family-history data: graph traversal, search, maps, layout, ingest."""
