"""Spark-native analytics over agent memory: events, memory units, graph, retrieval."""
