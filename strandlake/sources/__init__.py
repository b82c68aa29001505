"""Readers and writers of text formats; all lines stay distributed."""
