"""Queries by problem."""
