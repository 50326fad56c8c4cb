"""From a log of scores to alerts, escalations and their sums.

The log has a row for each stay and step of time: stay, at, site, unit, risk, score and high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import joins, timegrid


def _hours(hours: float) -> Column:
    return F.expr(f"INTERVAL {int(hours)} HOURS")


def hours_between(early: str, late: str) -> Column:
    """Hours from one column's time to another's."""
    return (joins.seconds(late) - joins.seconds(early)) / 3600


def onsets(log: DataFrame, step_seconds: int, quiet_hours: float) -> DataFrame:
    """Rows at which a stay turns high, without those within `quiet_hours` of the last one that counted."""
    return timegrid.suppressed(timegrid.entries(log, "stay", "at", "high", step_seconds), "stay", "at", quiet_hours)


def alerts(log: DataFrame, outcomes: DataFrame, known_by: str, step_seconds: int = 3600, horizon_hours: int = 6) -> DataFrame:
    """Onsets with their outcome: escalated is 1 if the stay's first event follows within the horizon, 0 if the horizon
    has passed by `known_by` without, null before that."""
    first = outcomes.groupBy("stay").agg(F.min("event_at").alias("event_at"))
    rows = onsets(log, step_seconds, horizon_hours).join(first, "stay", "left")
    end = F.col("at") + _hours(horizon_hours)
    hit = F.coalesce((F.col("event_at") > F.col("at")) & (F.col("event_at") <= end), F.lit(False))
    known = end <= F.lit(known_by).cast("timestamp")
    name = F.concat_ws("@", F.col("stay").cast("string"), F.date_format("at", "yyyyMMdd'T'HH"))
    return rows.select(
        name.alias("alert_id"), "stay", "site", "unit", F.col("at").alias("alert_at"), "risk", "score",
        F.when(hit, 1).when(known, 0).alias("escalated"), F.when(hit, hours_between("at", "event_at")).alias("hours_to_event"),
    )


def escalations(log: DataFrame, outcomes: DataFrame, known_by: str, horizon_hours: int = 6) -> DataFrame:
    """Events known by then that have an earlier score: the last one before, and whether and since when it was high."""
    known = outcomes.where(F.col("event_at") <= F.lit(known_by).cast("timestamp"))
    rows = known.join(log, "stay").where(F.col("at") < F.col("event_at"))
    near = F.col("high") & (F.col("at") >= F.col("event_at") - _hours(horizon_hours))
    sums = rows.groupBy("stay", "event_at").agg(
        F.max_by("risk", "at").alias("risk_before"), F.max_by("site", "at").alias("site"), F.max_by("unit", "at").alias("unit"), F.min(F.when(near, F.col("at"))).alias("first_high")
    )
    return sums.select("stay", "event_at", "site", "unit", "risk_before", F.col("first_high").isNotNull().alias("flagged"), hours_between("first_high", "event_at").alias("hours_flagged"))


def kpis(log: DataFrame, alert_rows: DataFrame, outcomes: DataFrame, step: str = "hour") -> DataFrame:
    """site, unit, at: census, high and low counts, mean score, alerts, and escalations in the unit of the last score."""
    keys = ["site", "unit", "at"]
    base = log.groupBy(*keys).agg(
        F.countDistinct("stay").alias("census"), F.count_if("high").alias("n_high"), F.count_if(~F.col("high")).alias("n_low"), F.avg("score").alias("mean_score")
    )
    raised = alert_rows.groupBy("site", "unit", F.col("alert_at").alias("at")).agg(F.count("*").alias("alerts"))
    floored = outcomes.withColumn("slot", F.date_trunc(step, "event_at"))
    placed = joins.asof_join(floored, log.select("stay", "at", "site", "unit"), "stay", "slot", "at", ["site", "unit"]).where("site IS NOT NULL")
    events = placed.groupBy("site", "unit", F.col("slot").alias("at")).agg(F.count("*").alias("escalations"))
    return base.join(raised, keys, "left").join(events, keys, "left").fillna(0, ["alerts", "escalations"])


def episodes(log: DataFrame, label: str, step_seconds: int) -> DataFrame:
    """Runs of positive steps: first, last, whether any was high, and lead time from the first high one to the end."""
    runs = timegrid.islands(log.where(F.col(label) == 1), "stay", "at", step_seconds)
    sums = runs.groupBy("stay", "island").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min(F.when(F.col("high"), F.col("at"))).alias("first_high"))
    lead = hours_between("first_high", "last_at") + 1
    return sums.select("stay", "island", "first_at", "last_at", F.col("first_high").isNotNull().alias("caught"), lead.alias("lead_hours"))


def alert_metrics(log: DataFrame, onset_rows: DataFrame, label: str, patients_per_nurse: int = 5, shift_hours: int = 12, step_seconds: int = 3600) -> DataFrame:
    """One row: alerts, alerts a nurse and shift, precision at the alerts, share of high steps, runs of positive steps,
    the share of them that were flagged, and the median hours of warning."""
    steps = log.agg(F.count("*").alias("n"), F.avg(F.col("high").cast("double")).alias("share_high"))
    fired = onset_rows.agg(F.count("*").alias("alerts"), F.avg(F.col(label).cast("double")).alias("precision"))
    runs = episodes(log, label, step_seconds).agg(F.count("*").alias("escalations"), F.avg(F.col("caught").cast("double")).alias("flagged"), F.median("lead_hours").alias("median_lead"))
    row = steps.crossJoin(fired).crossJoin(runs)  # one row each
    load = F.try_divide(F.col("alerts") * patients_per_nurse * shift_hours, "n").alias("per_nurse_shift")
    return row.select("alerts", load, "precision", "share_high", "escalations", "flagged", "median_lead")


def candidate_thresholds(log: DataFrame, risk: str = "risk", grid: int = 300, low: float = 0.5, high: float = 0.9999) -> list[float]:
    """Distinct quantiles of the scores from `low` to `high`, largest first: as many as the grid has at most."""
    shares = [low + (high - low) * i / (grid - 1) for i in range(grid)]
    row = metrics.quantiles(log, risk, shares).first()
    return sorted(set(row.quantiles), reverse=True) if row else []


def budget_threshold(log: DataFrame, candidates: list[float], budget: float, step_seconds: int, quiet_hours: float) -> float | None:
    """The lowest threshold, from the highest down, before alerts a step first exceed the budget.

    All candidates are tried in one pass: each row is repeated for those that it passes, at most as many as there are.
    """
    each = F.explode(F.array(*[F.lit(c) for c in candidates]))
    key = F.concat_ws("/", F.col("stay").cast("string"), F.col("threshold").cast("string"))
    rows = log.withColumn("threshold", each).where(F.col("risk") >= F.col("threshold")).withColumn("high", F.lit(True)).withColumn("stay", key)
    # steps that are not high only part runs of those that are, which the steps' times do as well
    counts = {r.threshold: r["count"] for r in onsets(rows, step_seconds, quiet_hours).groupBy("threshold").count().collect()}
    steps, best = log.count(), None
    for c in sorted(candidates, reverse=True):
        if counts.get(c, 0) > budget * steps:
            break
        best = c
    return max(candidates) if best is None and candidates else best


def labels(grid: DataFrame, outcomes: DataFrame, as_of: str, horizon_hours: int = 6, delay_hours: int = 6) -> DataFrame:
    """Labels as known at `as_of`: 1 if an event recorded by then lies in (at, at + horizon], 0 once horizon and delay
    have passed, else no row. known_at says when."""
    now = F.lit(as_of).cast("timestamp")
    recorded = outcomes.withColumn("recorded_at", F.col("event_at") + _hours(delay_hours)).where(F.col("recorded_at") <= now)
    g, o = grid.alias("g"), recorded.alias("o")
    inside = (F.col("o.event_at") > F.col("g.at")) & (F.col("o.event_at") <= F.col("g.at") + _hours(horizon_hours))
    rows = g.join(o, (F.col("g.stay") == F.col("o.stay")) & inside, "left").groupBy("g.stay", "g.at").agg(F.min("o.recorded_at").alias("recorded_at"))
    closed = F.col("at") + _hours(horizon_hours + delay_hours)
    label = F.when(F.col("recorded_at").isNotNull(), 1).when(closed <= now, 0)
    return rows.select("stay", "at", label.alias("label"), F.coalesce("recorded_at", closed).alias("known_at")).where("label IS NOT NULL")


def reference_labels(grid: DataFrame, outcomes: DataFrame, as_of: str, horizon_hours: int = 6) -> DataFrame:
    """Labels by all events up to `as_of`, without delay: 1 if one lies in (at, at + horizon], null while the horizon is open, else 0."""
    now = F.lit(as_of).cast("timestamp")
    g, o = grid.alias("g"), outcomes.where(F.col("event_at") <= now).alias("o")
    end = F.col("g.at") + _hours(horizon_hours)
    inside = (F.col("o.event_at") > F.col("g.at")) & (F.col("o.event_at") <= end)
    rows = g.join(o, (F.col("g.stay") == F.col("o.stay")) & inside, "left").groupBy("g.stay", "g.at").agg(F.count("o.event_at").alias("n"))
    closed = F.col("at") + _hours(horizon_hours)
    return rows.select("stay", "at", F.when(F.col("n") > 0, 1).when(closed <= now, 0).alias("label"), closed.alias("known_at"))


def device_health(readings: DataFrame, expected: DataFrame, key: str, ts: str, value: str, gap_minutes: int, run_length: int) -> DataFrame:
    """key, day: messages received and expected, uptime (at most 100, null if none expected), outages, stuck minutes, kinds of messages."""
    rows = timegrid.equal_runs(timegrid.gaps(readings, key, ts, gap_minutes), key, ts, value, run_length)
    daily = rows.groupBy(key, F.date_trunc("day", ts).alias("day")).agg(
        F.count("*").alias("received"), F.count_if("outage").alias("outages"), (F.count_if("stuck") * 5).alias("stuck_minutes"), 
        F.array_join(F.array_sort(F.collect_set("event_type")), "/").alias("kinds"),
    )
    both = daily.join(expected, [key, "day"], "full").fillna(0, ["received", "outages", "stuck_minutes", "expected"])
    return both.withColumn("uptime", F.when(F.col("expected") > 0, F.least(F.lit(100.0), F.lit(100.0) * F.col("received") / F.col("expected"))))
