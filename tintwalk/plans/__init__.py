"""From formulas to DataFrames."""
