"""Chains of operators: recorded actions, automatic cleaning, versioned tables."""
