"""DataFrame operators; every function takes and returns DataFrames and names its columns by parameter."""
