"""sources of the sequence analytics library."""
