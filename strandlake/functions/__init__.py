"""Column functions and the small kernels that run inside Arrow tasks."""
