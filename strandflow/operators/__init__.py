"""The engine's operators on DataFrames."""
