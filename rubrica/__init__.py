"""Artifact quality analytics on Spark DataFrames."""
