"""Table operators for public-office records, written for Spark DataFrames."""
