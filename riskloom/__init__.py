"""riskloom: interpretable binary-risk analytics on Spark DataFrames."""
