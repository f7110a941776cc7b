"""Scans and loads of tables."""
