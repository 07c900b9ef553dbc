"""Loading tables for a session; scripts themselves have no readers."""

from .tables import bind, load, sources
