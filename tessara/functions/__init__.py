"""Column functions: strings, numbers, vectors, cameras."""
