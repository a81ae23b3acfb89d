"""Relational operators: pages, index, search, snippets, annotations."""
