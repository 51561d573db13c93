"""Spend analytics on Spark: ledgers of card statements as DataFrames."""
