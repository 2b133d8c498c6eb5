"""Credit-risk feature engineering and scorecard analytics on Spark DataFrames."""
