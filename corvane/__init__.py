"""A Spark-first engine for document analytics, retrieval and training-data preparation."""
