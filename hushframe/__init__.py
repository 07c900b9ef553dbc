"""Disclosure-controlled analytics on Spark."""

from .policy import PRESETS, Level, Policy, Profile, Suppression, resolve_policy
from .session import Result, run

__all__ = ["PRESETS", "Level", "Policy", "Profile", "Result", "Suppression", "resolve_policy", "run"]
