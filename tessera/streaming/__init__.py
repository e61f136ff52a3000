"""Structured Streaming counterparts. Each function takes and gives DataFrames, streaming or not."""
