"""SPARQL: text to algebra, algebra to DataFrames."""
