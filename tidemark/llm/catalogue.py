"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: enter a (spark, sf_dir) query under `name`, with the DuckDB SQL that gives the same rows."""

    def enter(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return enter


def read(spark, sf_dir: str, name: str):
    """One table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from tidemark.llm import queries  # noqa: E402, F401
