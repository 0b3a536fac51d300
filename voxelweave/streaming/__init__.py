"""Streaming form of the progress log."""
