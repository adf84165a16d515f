"""millrace: dense-retrieval data processing on Spark, written as DataFrame operators."""
