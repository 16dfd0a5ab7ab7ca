"""Panel operators: each takes and returns DataFrames and stays lazy."""
