"""lexspan: a PySpark-native engine for timestamped transcripts."""
