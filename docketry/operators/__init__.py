"""Relational operators over flat tables."""
