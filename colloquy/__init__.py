"""PySpark-native analytics for multi-turn conversation logs."""
