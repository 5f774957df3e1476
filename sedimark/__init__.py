"""Sedimark: a Spark-native analytics engine for code, text and dependency graphs."""
