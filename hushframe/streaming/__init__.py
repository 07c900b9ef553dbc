"""Suppressed counts over event time."""

from .windows import windowed_counts
