"""Retail-offer analytics on Spark DataFrames."""
