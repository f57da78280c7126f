"""Sources of wharfline."""
