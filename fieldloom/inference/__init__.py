"""Iterative inference: driver loops around distributed evaluations."""
