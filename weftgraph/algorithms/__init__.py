"""Algorithms over graphs, matrices and ratings."""
