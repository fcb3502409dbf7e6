"""Operators for building training data from a document corpus.

Each module holds one operator with a general interface (any id and text column); ``queries`` applies them to
the given tables with production parameters.  Nothing else in the library imports this sub-package.
"""
