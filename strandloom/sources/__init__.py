"""Readers and writers of text formats, and views over the given tables."""
