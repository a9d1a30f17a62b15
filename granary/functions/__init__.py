"""Scalar expressions: comparison and arithmetic matrix, strings, dates, decimals, hashes."""

from .exprs import *  # noqa: F403
