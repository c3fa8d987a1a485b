"""Operators for preparing large text corpora for model training.

Self-contained: nothing outside this package imports it.  Every operator takes
and returns DataFrames; ``queries.py`` holds the thin registered queries.
"""
