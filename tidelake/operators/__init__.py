"""Batch operators over lake tables."""
