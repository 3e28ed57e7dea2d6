"""A Spark-native engine for bounded lookups over schemaless memory records."""
