"""Relational operators: ranking, pruning, geometry, prompts, nested records."""
