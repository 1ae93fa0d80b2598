"""operators of the sequence analytics library."""
