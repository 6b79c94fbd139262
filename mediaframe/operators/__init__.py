"""Operators on ordered series, intervals, events, text, audio and motion; each takes and returns lazy DataFrames."""
