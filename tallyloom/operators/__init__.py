"""The analyses: functions from DataFrames to a DataFrame."""
