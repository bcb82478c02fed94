"""Operators on DataFrames: alignment, episodes, statistics, offsets, relations, media and models."""
