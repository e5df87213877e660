"""Readers and writers of rasters, masks, layers and annotation files."""
