"""Operators for preparing large text and vector corpora; nothing else in the library imports them."""
