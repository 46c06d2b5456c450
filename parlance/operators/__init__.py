"""DataFrame operators: every function takes DataFrames and returns DataFrames."""
