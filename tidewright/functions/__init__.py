"""Scalar, AI, media and download functions."""
