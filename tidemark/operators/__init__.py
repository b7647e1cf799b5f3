"""Operators over the long series form."""
