"""Functions of wharfline."""
