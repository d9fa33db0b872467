"""Spark-native engine for judgments about rows and row pairs kept as fresh, queryable relational state."""
