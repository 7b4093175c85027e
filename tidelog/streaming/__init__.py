"""Streams over event logs: tails, windows, sessions, deduplication, watermarks."""
