"""streaming of the sequence analytics library."""
