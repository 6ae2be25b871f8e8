"""Analytics over recognised document pages, as Spark DataFrames."""
