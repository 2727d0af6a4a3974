"""A PySpark-native engine for moving, reshaping and checking tabular data."""
