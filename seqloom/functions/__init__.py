"""functions of the sequence analytics library."""
