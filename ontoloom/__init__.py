"""Spark-first engine for RDF-style graph tables: SPARQL, loaders and bulk operators."""

__version__ = "0.1.0"
