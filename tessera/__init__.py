"""Spark-first multi-model analytics: relational, time-series, vector, graph, spatial, JSON and streaming operators."""
