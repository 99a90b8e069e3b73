"""Whole plans: the warehouse and its views, registries, reports; and the queries over test tables."""
