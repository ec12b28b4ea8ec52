"""Temporal, hybrid and first-order logic over coloured transition systems, evaluated as Spark DataFrames."""
