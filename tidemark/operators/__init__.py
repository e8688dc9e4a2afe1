"""Operators: functions from DataFrames and parameters to a lazy DataFrame."""
