"""Source text treated as data: a PySpark-native analysis engine."""
