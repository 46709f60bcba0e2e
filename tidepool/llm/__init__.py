"""Operators for preparing text and vector corpora for model training.

Nothing outside this package imports it; it can be deleted as a whole.
"""
