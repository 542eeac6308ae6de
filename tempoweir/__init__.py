"""Event-time stream analytics lowered to Spark DataFrames."""
