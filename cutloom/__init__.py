"""cutloom: a PySpark-native engine for turning timestamped recordings into ranked highlight edits."""
