"""Column-level functions: scalar rules and tail probabilities."""
