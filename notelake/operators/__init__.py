"""DataFrame-in, DataFrame-out operators, by family."""
