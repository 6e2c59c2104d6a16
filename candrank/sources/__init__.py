"""Sources of the candidate-ranking library."""
