"""Operators for training data: one module per operator, each ``DataFrame -> DataFrame``.

Nothing outside this package imports it.  ``queries`` holds what is registered.
"""
