"""Part of tessera, a PySpark-native analytics engine for chunked, replicated storage."""
