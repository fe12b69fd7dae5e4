"""Knowledge-graph analytics and retrieval on Spark DataFrames."""
