"""Column functions and the small array kernels that run inside tasks."""
