"""Bars, features, labels, strategies and metrics of probability estimation as DataFrame transforms."""
