"""textloom: document ingestion, hybrid retrieval and retrieval evaluation on Spark DataFrames."""
