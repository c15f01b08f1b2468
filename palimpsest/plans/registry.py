"""Queries by name with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans.tables import CTE

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a function; names of derived tables in its SQL are defined in front of it."""

    def kept(f: Builder) -> Builder:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = " ".join(sql.split())
            used = [f"{n} as ({e})" for n, e in CTE.items() if f" {n}" in f" {text}"]
            word = "with recursive" if text.startswith("with recursive ") else "with"
            own = text.removeprefix(f"{word} ") if text.startswith("with ") else None
            parts = [*used, *([own.split(" :: ", 1)[0]] if own else [])]
            rest = own.split(" :: ", 1)[1] if own else text
            ORACLES[f.__name__] = f"{word} {', '.join(parts)} {rest}" if parts else rest
        return f

    return kept
