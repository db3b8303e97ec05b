"""A Spark-native engine for corpus indexing, hybrid retrieval and corpus processing."""
