"""tessera: a PySpark-native engine for retrieval and model-evaluation analytics."""
