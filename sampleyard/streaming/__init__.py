"""Structured Streaming: following new files into a catalog."""
