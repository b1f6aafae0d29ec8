"""A PySpark-native engine for building, cleaning and analysing knowledge graphs."""
