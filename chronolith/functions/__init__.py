"""Aggregates and period predicates."""
