"""Operators that prepare training text. Nothing else in the library imports this subpackage.

Column names that begin with two underscores are the operators' own: inputs must not have any.
"""
