"""Operators for cleaning and mixing text corpora, and their queries."""
