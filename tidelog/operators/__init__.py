"""DataFrame operators: alignment, archives, registries, discovery, arrays, integrity."""
