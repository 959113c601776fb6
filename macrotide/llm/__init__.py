"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage, so it can be left out.
"""
