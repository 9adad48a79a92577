"""Operators on registry pages and tables."""
