"""Reads, merges and aggregates: functions from DataFrames to DataFrames."""
