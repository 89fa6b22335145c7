"""Check SQL for every query, written for DuckDB from the report rules.

It shares the input SELECTs with the package and nothing else, and states its own texts: windows are range
joins, the latest row comes from a row number, and rule tables are joined.
"""

from oracle.queries import oracle_queries

__all__ = ["oracle_queries"]
