"""Scalar vocabulary: decay, kernels, saturation, calendar terms, error metrics."""
