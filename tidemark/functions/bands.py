"""Scores by bands of a value, and the early-warning score made of seven of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, edges: Sequence[float], scores: Sequence[int]) -> Column:
    """scores[i] for the first edge that is not below the value, the last score beyond all edges; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for edge, score in zip(edges, scores, strict=False):
        out = out.when(value <= edge, F.lit(score))
    return out.otherwise(F.lit(scores[-1]))


#: Fixed values of the published early-warning score: upper edges (inclusive) and points.
BANDS = {
    "resp_rate": ((8, 11, 20, 24), (3, 1, 0, 2, 3)),
    "spo2_scale_1": ((91, 93, 95), (3, 2, 1, 0)),
    "spo2_scale_2": ((83, 85, 87), (3, 2, 1, 0)),
    "spo2_scale_2_on_oxygen": ((92, 94, 96), (0, 1, 2, 3)),
    "sbp": ((90, 100, 110, 219), (3, 2, 1, 0, 3)),
    "heart_rate": ((40, 50, 90, 110, 130), (3, 1, 0, 1, 2, 3)),
    "temp_c": ((35, 36, 38, 39), (3, 1, 0, 1, 2)),
}
OXYGEN_POINTS, NOT_ALERT_POINTS = 2, 3


def early_warning(resp_rate: Column, spo2: Column, sbp: Column, heart_rate: Column, temp_c: Column, on_oxygen: Column, alertness: Column, scale_2: Column) -> dict[str, Column]:
    """The seven parts and their total (null if a part is). Values are rounded half-even, temperature to 0.1."""
    whole = {n: F.bround(c, 0) for n, c in (("resp_rate", resp_rate), ("sbp", sbp), ("heart_rate", heart_rate))}
    oxygen = F.coalesce(on_oxygen, F.lit(False))
    level = F.bround(spo2, 0)
    second = F.when(oxygen & (level >= 93), band(level, *BANDS["spo2_scale_2_on_oxygen"])).otherwise(band(level, *BANDS["spo2_scale_2"]))
    parts = {n: band(c, *BANDS[n]) for n, c in whole.items()}
    parts["spo2"] = F.when(scale_2, second).otherwise(band(level, *BANDS["spo2_scale_1"]))
    parts["temp_c"] = band(F.bround(temp_c, 1), *BANDS["temp_c"])
    parts["oxygen"] = F.when(oxygen, OXYGEN_POINTS).otherwise(0)
    parts["alertness"] = F.when(F.coalesce(alertness, F.lit("A")) == "A", 0).otherwise(NOT_ALERT_POINTS)
    return parts | {"total": reduce(add, parts.values())}


def age_band(age: Column) -> Column:
    """Half-open bands of adult ages; others have none."""
    edges = (18, 50, 70, 85, 200)
    out = F.lit(None).cast("string")
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((age >= low) & (age < high), f"{low}-{high - 1}").otherwise(out)
    return out
