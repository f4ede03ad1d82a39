"""papyrine: document analytics on Spark DataFrames."""
