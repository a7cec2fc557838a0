"""heddle: a Spark-native engine for hybrid retrieval, two-sided matching and data preparation."""
