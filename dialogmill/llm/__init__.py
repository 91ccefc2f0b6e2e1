"""Operators for preparing training text: the operators, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
