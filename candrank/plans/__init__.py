"""Plans of the candidate-ranking library."""
