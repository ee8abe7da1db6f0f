"""A Spark-native engine for curating multilingual bitext and evaluating sentence embeddings."""
