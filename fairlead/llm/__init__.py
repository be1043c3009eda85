"""Operators for large text and media corpora.  Nothing outside this subpackage imports it."""
