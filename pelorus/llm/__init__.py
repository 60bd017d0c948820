"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Operators take DataFrames, pick
the columns they need by exact name (extra or clashing columns are ignored)
and return DataFrames; models and reference tables are bounded by parameters.
"""
