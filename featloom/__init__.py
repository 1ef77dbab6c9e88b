"""A PySpark-native feature engine."""
