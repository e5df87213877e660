"""Operators over pixel, geometry, tile, annotation and detection tables: DataFrame to DataFrame."""
