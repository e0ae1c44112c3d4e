"""Structured Streaming: replay, sessions and carried state."""
