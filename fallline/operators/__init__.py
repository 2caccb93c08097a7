"""Set operations and grouped kernels on cell tables."""
