"""Readers of package archives and source trees."""
