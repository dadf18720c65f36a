"""Stored collections, vector files and their file system."""
