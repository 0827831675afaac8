"""Structured Streaming variants of batch operators (an extension)."""
