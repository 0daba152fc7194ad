"""Kinfold: a Spark-native entity-resolution and corpus engine."""
