"""Leakage-safe temporal analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and is parameterised by column
names (entity key, period column, value columns, horizons).
"""
