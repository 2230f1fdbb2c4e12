"""Sequencing-cohort analytics on Spark DataFrames."""
