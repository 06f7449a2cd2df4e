"""Reads that arrive as files. Operators that work on one read at a time need no state between batches."""
