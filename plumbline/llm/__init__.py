"""Operators for the making of training data. Nothing else in the package imports this one."""
