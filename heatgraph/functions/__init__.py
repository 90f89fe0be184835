"""Numpy kernels for what is small and iterative."""
