"""Lexical evidence analytics on Spark DataFrames."""
