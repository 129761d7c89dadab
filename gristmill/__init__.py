"""PySpark-native curation of large text corpora."""
