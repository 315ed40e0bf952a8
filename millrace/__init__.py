"""millrace: a Spark-native engine for web records and training-data pipelines."""
