"""Operators on markers, signals and their metadata; all take and return DataFrames."""
