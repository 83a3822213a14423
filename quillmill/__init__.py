"""Text analytics on Spark: segmentation, corpus statistics, findings, run comparison and graph tables as DataFrames."""
