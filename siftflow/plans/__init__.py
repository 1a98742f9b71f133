"""Rewrites of the plan and its translation to DataFrames."""
