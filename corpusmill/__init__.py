"""corpusmill: corpus analytics, retrieval and evaluation on Spark DataFrames."""
