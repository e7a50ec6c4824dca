"""Batch and streaming analytics over text, ratings, relations, records and job tables."""
