"""Scalar functions on columns, and the numpy kernels that need arrays."""
