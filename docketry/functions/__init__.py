"""Scalar functions: text, legal vocabulary, triage rules, statistics."""
