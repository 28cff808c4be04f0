"""Analytics patterns for tables and streams, written as Spark jobs.

Every operator is a function from DataFrames to a DataFrame. Nothing is parsed, planned or stored
here: Catalyst plans the work and Parquet tables hold it.
"""
