"""Operators of a training-data pipeline over whole text corpora.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
