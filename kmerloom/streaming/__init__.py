"""streaming of the k-mer engine."""
