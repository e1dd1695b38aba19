"""Graphloom: a PySpark-native engine for knowledge graphs, vector search and training-data pipelines."""
