"""Index-scan analytics over JSON documents and typed tables, on Spark DataFrames."""
