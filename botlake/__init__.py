"""Batch and streaming jobs for the data behind chatbot platforms, as functions from DataFrames to a DataFrame."""
