"""Mixed-language diary analytics on Spark DataFrames."""
