"""Relational operators that need more than a DataFrame call."""
