"""Column functions on sequences and k-mers."""
