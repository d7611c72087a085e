"""Training-data operators: one module for each, all of them on DataFrames.

Nothing outside this subpackage imports it.
"""
