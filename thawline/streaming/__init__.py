"""Structured Streaming: following an appended metric log."""
