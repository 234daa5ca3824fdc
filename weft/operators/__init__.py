"""Operators on graphs, collections, kernels and scores."""
