"""Operators for preparing language-model training text.

Nothing else in the package imports this subpackage; it can be removed as a
whole.  Each module holds one operator; ``queries`` and ``sql`` register them.
"""
