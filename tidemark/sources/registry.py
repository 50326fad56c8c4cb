"""Model versions, the champion among them, and the record of who changed it: append-only tables.

Each is a folder of Parquet files below the registry's root; the present state is the latest row.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

AUDIT = "event_id string, at timestamp, action string, model string, version int, before int, reason string"
#: Shares of replicates in which a challenger must be at least as good, and how far its Brier may rise.
SHARES = {"auprc": 0.75, "flagged": 0.75, "per_nurse_shift": 0.10}
BRIER_RISE = 1.10


class Refused(ValueError):
    """The change is not allowed; the message says why."""


class Registry:
    """Versions and champions of models under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def audit(self) -> DataFrame:
        """All events."""
        try:
            return self.spark.read.schema(AUDIT).parquet(f"{self.root}/audit")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], AUDIT)
            raise

    def champion(self, model: str) -> int | None:
        """The version that the last promotion or rollback set."""
        rows = self.audit().where(f"model = '{model}' AND action IN ('promote', 'rollback')").orderBy("at", "event_id").collect()
        return rows[-1].version if rows else None

    def _append(self, action: str, model: str, version: int, before: int | None, reason: str, event_id: str | None) -> None:
        event_id = event_id or uuid.uuid4().hex
        if self.audit().where(f"event_id = '{event_id}'").isEmpty():
            row = [(event_id, datetime.now(UTC), action, model, version, before, reason)]
            self.spark.createDataFrame(row, AUDIT).coalesce(1).write.mode("append").parquet(f"{self.root}/audit")

    def promote(self, model: str, version: int, compared_with: int | None, reason: str, event_id: str | None = None) -> None:
        """Makes a version the champion. It must have been compared with the present one. Repeating an event is no event."""
        if event_id and not self.audit().where(f"event_id = '{event_id}'").isEmpty():
            return
        now = self.champion(model)
        if compared_with != now:
            raise Refused(f"{model} {version} was compared with {compared_with}, the champion is {now}")
        self._append("promote", model, version, now, reason, event_id)

    def rollback(self, model: str, reason: str, event_id: str | None = None) -> int:
        """Makes the champion before the present one the champion again."""
        rows = self.audit().where(f"model = '{model}' AND action = 'promote'").orderBy("at", "event_id").collect()
        now = self.champion(model)
        before = next((r.before for r in reversed(rows) if r.version == now), None)
        if before is None:
            raise Refused(f"{model} has no earlier champion")
        self._append("rollback", model, before, now, reason, event_id)
        return before

    def reject(self, model: str, version: int, reason: str, event_id: str | None = None) -> None:
        """Notes that a version was turned down."""
        self._append("reject", model, version, self.champion(model), reason, event_id)


def passes_floor(candidate: dict, baseline: dict) -> bool:
    """Better AUPRC than the plain score, and no fewer events flagged."""
    return candidate["auprc"] > baseline["auprc"] and candidate["flagged"] >= baseline["flagged"]


def passes_champion(shares: dict, brier: float, champion_brier: float) -> bool:
    """At least as good as the champion in enough replicates, with a Brier score not much higher."""
    return all(shares[k] >= least for k, least in SHARES.items()) and brier <= BRIER_RISE * champion_brier
