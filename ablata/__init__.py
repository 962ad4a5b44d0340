"""Subset-perturbation influence analysis on Spark DataFrames."""
