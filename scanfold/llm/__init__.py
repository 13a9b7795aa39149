"""Operators for preparing text corpora; nothing outside this folder depends on them."""
