"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this folder imports it.  Every operator takes DataFrames with their own column names and gives
a DataFrame; ``queries`` holds the thin queries that apply the operators to the standard tables.
"""
