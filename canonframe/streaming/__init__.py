"""Structured Streaming jobs over change logs and activity events."""
