"""Structured Streaming jobs over file changes and chat turns."""
