"""logquill: log-anomaly analytics on Spark DataFrames."""
