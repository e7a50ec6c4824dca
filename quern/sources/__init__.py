"""Readers and writers of the text formats, and views over the table set."""
