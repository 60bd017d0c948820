"""Registered queries, by the operators that they exercise."""
