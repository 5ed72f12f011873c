"""Bulk operators over DataFrames."""
