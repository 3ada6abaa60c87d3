"""Spark-native structural analytics over entity-relation corpora."""
