"""Gridloom: a Spark engine for raster, vector, annotation and detection tables."""

__version__ = "0.1.0"
