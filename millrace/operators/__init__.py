"""Operators on DataFrames: filters, joins, roll-ups, ranking, diffs, matching."""
