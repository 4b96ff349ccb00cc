"""DataFrame operators: every one maps DataFrames to a DataFrame and stays lazy."""
