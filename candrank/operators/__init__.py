"""Operators of the candidate-ranking library."""
