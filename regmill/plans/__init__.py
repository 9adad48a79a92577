"""Registered queries, with the pages they render from the given tables."""
