"""Document-retrieval analytics on Spark: DataFrame in, DataFrame out."""
