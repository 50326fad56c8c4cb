"""tidemark: PySpark-native analytics for time-stamped, interval-linked event data."""
