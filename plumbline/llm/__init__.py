"""Operators for large-scale text corpora; nothing else in the package imports this one."""
