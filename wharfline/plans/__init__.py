"""Plans of wharfline."""
