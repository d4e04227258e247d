"""Operators over bags and tables."""
