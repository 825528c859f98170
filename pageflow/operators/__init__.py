"""Relational operators: rules, joins, cache, batching, extraction."""
