"""Visual-word retrieval, tracking and corpus jobs on Spark DataFrames."""
