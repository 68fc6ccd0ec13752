"""Civic-record analytics on Spark DataFrames."""
