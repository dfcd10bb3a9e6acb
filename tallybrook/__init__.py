"""tallybrook: evidence analytics on Spark DataFrames."""
