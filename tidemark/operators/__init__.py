"""Relational, time-aware and history operators: DataFrames in, DataFrames out."""
