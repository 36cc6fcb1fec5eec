"""Corpus analytics and curation on Spark DataFrames."""
