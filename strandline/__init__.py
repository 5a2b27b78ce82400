"""Knowledge-graph construction, validation and analytics on Spark DataFrames."""
