"""foliospark: a PySpark-native engine for scholarly and document data."""
