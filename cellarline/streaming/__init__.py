"""Append feeds."""
