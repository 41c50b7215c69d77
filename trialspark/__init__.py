"""Repeated-trial experiment analytics on Spark DataFrames."""
