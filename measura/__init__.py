"""measura: a PySpark-native engine for timed interval and sequence data."""
