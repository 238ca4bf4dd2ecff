"""Operators for preparing training corpora.

One module per operator.  Nothing outside this subpackage imports it;
``registry`` holds the thin queries over the standard tables.
"""
