"""Spark-native analytics over creators, projects, contents and their metrics."""
