"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; ``queries.py`` binds them to the standard tables.
"""
