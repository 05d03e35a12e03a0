"""Saved-place analytics on Spark: every scalar a Column, every operator a DataFrame transformation."""
