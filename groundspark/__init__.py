"""A Spark-native engine for grounded document retrieval: every operator is a DataFrame-to-DataFrame transformation."""
