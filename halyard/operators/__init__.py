"""Exact and approximate nearest-neighbour operators."""
