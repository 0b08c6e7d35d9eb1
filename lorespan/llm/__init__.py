"""Operators for text and names in corpora for language models."""
