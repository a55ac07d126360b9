"""operators of the k-mer engine."""
