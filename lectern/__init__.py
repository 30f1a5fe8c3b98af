"""lectern: document analytics over Spark DataFrames."""
