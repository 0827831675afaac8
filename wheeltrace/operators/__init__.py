"""Operators: functions from DataFrames to DataFrames, each a declared plan that Catalyst optimises."""
