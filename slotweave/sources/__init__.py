"""Readers and writers of the library's tables."""
