"""Operators: functions from DataFrames to DataFrames, without any store behind them."""
