"""tessel: a PySpark-native analytics engine over source-code knowledge graphs."""
