"""A PySpark-native engine for timestamped binary log data."""
