"""Readers, writers, derived star schema and relation generators."""
