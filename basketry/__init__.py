"""Basket analytics on Spark: flatten, split, count, recommend, score."""
