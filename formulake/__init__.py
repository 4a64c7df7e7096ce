"""Formulation-data analytics on Spark DataFrames."""
