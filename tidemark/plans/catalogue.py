"""All named queries outside the llm subpackage, and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: enter a (spark, sf_dir) query under `name`, with the DuckDB SQL that gives the same rows."""

    def enter(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return enter


from tidemark.plans import records, search, signals, timeline  # noqa: E402, F401, I001
from tidemark.plans import named, pipelines, summaries  # noqa: E402, F401
from tidemark.plans import checks, semantic  # noqa: E402, F401
