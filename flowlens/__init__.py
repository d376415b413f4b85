"""flowlens: flow-window analytics on Spark DataFrames."""
