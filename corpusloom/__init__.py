"""Document-knowledge analytics on Spark: every operator is a lazy DataFrame transformation."""
