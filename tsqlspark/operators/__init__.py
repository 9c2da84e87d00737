"""Writes: statements that turn one version of a table into the next."""
