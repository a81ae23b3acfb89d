"""Whole plans: building a corpus, searching it."""
