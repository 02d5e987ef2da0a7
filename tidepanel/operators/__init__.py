"""Operators: functions from a panel and parameters to a DataFrame."""
