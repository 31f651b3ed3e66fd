"""Expressions: predicates, coercion of values, date keys."""
