"""Table operators: each takes DataFrames and returns an Outcome or a DataFrame."""
