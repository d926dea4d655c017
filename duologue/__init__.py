"""Analytics over scored dialogue episodes and scenario archives, as Spark DataFrames."""
