"""A PySpark-native engine for nearest-neighbour classification analytics."""
