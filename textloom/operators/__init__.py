"""Operators as functions of DataFrames."""
