"""Analytics over directed graphs of record streams, on Spark DataFrames."""
