"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this package.  Each module holds one
operator; ``catalog`` registers the queries and their SQL.
"""
