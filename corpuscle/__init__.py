"""A Spark-native engine for document corpora: search, occurrence queries, incremental tables and review runs."""
