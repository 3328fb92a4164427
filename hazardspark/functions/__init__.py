"""Scalar functions as Column builders, with Python twins for request-side values."""
