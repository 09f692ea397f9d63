"""PySpark-native document ingestion and chunking."""
