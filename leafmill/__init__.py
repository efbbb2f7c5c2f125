"""leafmill: Spark-native document ingestion, chunking and retrieval over DataFrames."""
