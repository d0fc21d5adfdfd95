"""Finding, reading and generating lake tables."""
