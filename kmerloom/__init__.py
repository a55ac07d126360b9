"""k-mer and de Bruijn-graph analytics expressed as Spark DataFrames."""
