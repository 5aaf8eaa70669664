"""Vector search by product quantization and corpus processing, on Spark DataFrames."""
