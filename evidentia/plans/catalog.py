"""The queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Adds a query (session, folder of tables) -> DataFrame; its SQL may use the derived tables of fixtures."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {X.SQL.strip()} {sql}"
        return f

    return add
