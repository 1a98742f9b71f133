"""The pipe language: text to tokens to an immutable plan, and back to canonical text."""
