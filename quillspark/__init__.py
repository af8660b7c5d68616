"""PySpark-native analytics for step-level reasoning supervision data."""
