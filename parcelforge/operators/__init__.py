"""Relational operators of the review office, as functions from DataFrame to DataFrame."""
