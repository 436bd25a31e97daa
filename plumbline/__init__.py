"""plumbline: a PySpark-native engine for layered contract, performance and media analytics."""
