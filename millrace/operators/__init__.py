"""Operators on changelogs and tables."""
