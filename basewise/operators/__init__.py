"""Relational operators of the engine; all take and return DataFrames."""
