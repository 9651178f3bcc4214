"""Readers and writers of raw files and of the compiled store."""
