"""Focal functions as Column expressions and as NumPy kernels."""
