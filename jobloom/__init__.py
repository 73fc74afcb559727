"""Listing-catalogue analytics on Spark: DataFrame in, DataFrame out."""
