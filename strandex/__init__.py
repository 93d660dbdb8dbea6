"""strandex: evidence retrieval and sequence analytics expressed as Spark DataFrames."""
