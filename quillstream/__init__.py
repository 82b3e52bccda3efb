"""Curation and analytics of text streams, expressed with Spark DataFrames."""
