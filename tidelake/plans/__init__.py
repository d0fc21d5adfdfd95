"""Guarded SQL, joins and probes."""
