"""Operators for preparing training text: one module per operator, queries in ``queries``.

Nothing outside this package imports it.
"""
