"""Queries over the test tables, by topic."""
