"""Streaming of wharfline."""
