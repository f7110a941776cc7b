"""Whole queries made of several operators."""
