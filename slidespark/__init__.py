"""Spatial-transcriptomics analytics on Spark DataFrames."""
