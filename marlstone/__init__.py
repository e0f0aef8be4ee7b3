"""marlstone: retrieval, entity and graph analytics on Spark DataFrames."""
