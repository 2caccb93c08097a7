"""Reading and writing grids."""
