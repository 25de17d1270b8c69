"""Operators that derive tables of structure from units, and those that turn drafts into findings."""
