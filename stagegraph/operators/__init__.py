"""Operators on DataFrames: lines, splits, resolution, intervals, lineage, statistics, checks."""
