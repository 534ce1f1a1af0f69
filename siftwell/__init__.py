"""Evidence retrieval, document analytics and training-data preparation on PySpark."""
