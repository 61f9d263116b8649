"""DataFrame-to-DataFrame operators of the retrieval and ranking engine."""
