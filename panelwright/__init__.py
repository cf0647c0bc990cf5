"""Panel change-point, segmentation and policy analytics on Spark DataFrames."""
