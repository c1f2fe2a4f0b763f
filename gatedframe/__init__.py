"""gatedframe: aggregate-only analytics over Spark DataFrames."""
