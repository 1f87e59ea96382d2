"""Structured Streaming over landing folders."""
