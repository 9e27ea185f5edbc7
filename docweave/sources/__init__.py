"""Readers and table writers."""
