"""Incremental runs of the payload normalization."""
