"""Composed attribution plans."""
