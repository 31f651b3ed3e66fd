"""Logical plans of queries."""
