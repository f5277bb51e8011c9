"""Readers and parsers that turn files and text into DataFrames."""
