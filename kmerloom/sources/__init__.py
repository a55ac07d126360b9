"""sources of the k-mer engine."""
