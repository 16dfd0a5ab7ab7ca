"""Whole research workflows composed from the operators."""
