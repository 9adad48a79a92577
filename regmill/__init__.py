"""Analytics over registry pages, and corpus preparation, on Spark DataFrames."""
