"""Incremental re-checking of recorded claims."""
