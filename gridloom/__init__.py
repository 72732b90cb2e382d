"""A PySpark-native analytics engine for tabular, text and map data."""
