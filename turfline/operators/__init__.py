"""Operators over runner tables: DataFrame in, DataFrame out."""
