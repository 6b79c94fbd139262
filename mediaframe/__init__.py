"""Ordered media measurements as Spark DataFrames: series, intervals, events, text and image operators."""
