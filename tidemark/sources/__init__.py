"""Readers, payload normalization and writers."""
