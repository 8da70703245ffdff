"""cadenza: segmentation of long multimodal time series, written on Spark DataFrames."""
