"""pagemill: a PySpark-native engine for document-extraction and training-data tables."""
