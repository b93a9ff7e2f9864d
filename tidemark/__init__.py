"""Point-in-time research analytics and corpus preparation on Spark DataFrames."""
