"""A PySpark-native engine for graph and vector retrieval, answer evaluation and corpus preparation."""
