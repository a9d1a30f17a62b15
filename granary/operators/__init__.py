"""Relational operators as compositions of DataFrame operations."""

from .relational import *  # noqa: F403
