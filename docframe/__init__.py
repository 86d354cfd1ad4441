"""docframe: a PySpark-native engine for structured word-processor documents and text corpora."""
