"""lamina: strongly typed, immutable columnar datasets on Spark DataFrames."""
