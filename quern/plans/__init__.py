"""Queries over the table set and the jobs by name."""
