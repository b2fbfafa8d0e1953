"""Structured Streaming over report files."""
