"""Shelf-price panel analytics on Spark: every operator takes and returns DataFrames."""
