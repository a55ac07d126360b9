"""plans of the k-mer engine."""
