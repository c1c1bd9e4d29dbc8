"""graphspan: labelled-graph feature analytics on Spark DataFrames."""
