"""Scans of files, tables and catalogues into DataFrames."""
