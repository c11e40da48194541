"""Curation operators: DataFrame in, DataFrame out."""
