"""Functions of the candidate-ranking library."""
