"""Scaling and column functions."""
