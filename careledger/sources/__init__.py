"""Readers for the 18 input tables, and the report sink."""
