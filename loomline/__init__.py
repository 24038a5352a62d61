"""Loomline: transcript analytics as lazy Spark DataFrames."""
