"""Operators of wharfline."""
