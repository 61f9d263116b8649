"""Column builders: text derivation, scores, vectors and metadata predicates."""
