"""Profiling of semi-structured data exports, schema tracking over time, and corpus operators, on Spark DataFrames."""
