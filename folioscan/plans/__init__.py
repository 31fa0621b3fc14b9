"""Whole checks assembled from operators, and the registered queries."""
