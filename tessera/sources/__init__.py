"""Readers and writers for matrices, labels, priors and results."""
