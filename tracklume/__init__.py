"""tracklume: trajectory, risk-evaluation and text-corpus analytics on Spark DataFrames."""
