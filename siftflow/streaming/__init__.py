"""Structured Streaming: the live tail and statistics over windows of time."""
