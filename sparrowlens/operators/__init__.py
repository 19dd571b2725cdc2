"""DataFrame operators: tokens, windows, pooling, search, layout, clustering, checks."""
