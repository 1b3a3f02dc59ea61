"""Relational operators over recordings: ranges, joins, coverage, statistics."""
