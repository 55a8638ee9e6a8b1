"""trajmill: agent-trajectory analytics on Spark DataFrames."""
