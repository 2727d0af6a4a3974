"""Readers, parsers and ways to cut a table into parts."""
