"""Incremental forms of the bar, factor and label operators."""
