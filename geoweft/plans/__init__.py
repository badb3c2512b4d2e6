"""Registered queries over the reference operators, and their SQL."""
