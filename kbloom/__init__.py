"""Web-knowledge analytics expressed as Spark DataFrames."""
