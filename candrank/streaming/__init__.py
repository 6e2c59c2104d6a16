"""Streaming of the candidate-ranking library."""
