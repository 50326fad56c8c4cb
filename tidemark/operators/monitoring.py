"""Drift checks: a scored window against the data that its model was made from, by slice, and what the checks say together.

A signal is a row: signal, feature, site, value (what its level is judged on), observed, reference, n, level. Slices are
`all` and each site, by one pass over rows that are doubled, not by a query for each slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import alerts

ALL = "all"
#: Positive runs that a window needs before its ranking is judged, and the share of coverage that a change must clear.
MIN_RUNS, SURE = 10, 0.95
SIGNAL = ("signal", "feature", "site", "value", "observed", "reference", "n", "level")
#: What each signal is about.
KINDS = {
    "feature_psi": "inputs",
    "prediction_js": "predictions",
    "alerts_per_nurse_shift": "alert-load",
    "auprc_drop": "performance",
    "brier_rise": "performance",
    "quarantine_rate": "data-quality",
    "missing_rate_change": "data-quality",
    "monitor_difference": "monitor",
}
#: A distance in natural logarithms is so many times the same one in base 2: the square root of ln 2.
NATURAL = 0.8325546111576977


def sliced(rows: DataFrame, site: str = "site") -> DataFrame:
    """The rows twice, with `slice`: all, and their site."""
    return rows.withColumn("slice", F.explode(F.array(F.lit(ALL), F.col(site).cast("string"))))


def signal_rows(rows: DataFrame, name: str, value: Column, n: Column, site: Column, feature: Column | None = None, observed: Column | None = None, reference: Column | None = None) -> DataFrame:
    """Signals from the columns of a table."""
    nothing = F.lit(None).cast("double")
    value = value.cast("double")
    out = rows.select(
        F.lit(name).alias("signal"), (F.lit(None).cast("string") if feature is None else feature).alias("feature"), site.alias("site"), value.alias("value"),
        (value if observed is None else observed.cast("double")).alias("observed"), (nothing if reference is None else reference.cast("double")).alias("reference"), n.cast("long").alias("n"),
    )
    return out.withColumn("level", metrics.level(F.col("signal"), F.col("value")))


def input_drift(baseline: DataFrame, current: DataFrame, features: Sequence[str], site: str = "site") -> DataFrame:
    """PSI of each feature in each slice that the current rows have; one pass over either side for all of them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("pair")
    long = lambda rows: sliced(rows, site).select("slice", pairs).select("slice", "pair.feature", "pair.v")
    now = long(current)
    every = now.groupBy("slice", "feature").agg(F.count("v").alias("n"))
    found = metrics.distances(long(baseline), now, "v", ["slice", "feature"]).select("slice", "feature", "psi")
    return signal_rows(every.join(found, ["slice", "feature"], "left"), "feature_psi", F.col("psi"), F.col("n"), F.col("slice"), F.col("feature"))


def prediction_drift(baseline: DataFrame, current: DataFrame, risk: str = "risk", site: str = "site") -> DataFrame:
    """Jensen-Shannon distance of the scores in each slice."""
    now = sliced(current, site)
    every = now.groupBy("slice").agg(F.count("*").alias("n"))
    found = metrics.distances(sliced(baseline, site), now, risk, ["slice"]).select("slice", "js")
    return signal_rows(every.join(found, "slice", "left"), "prediction_js", F.col("js"), F.col("n"), F.col("slice"))


def alert_load(log: DataFrame, start: str, step_seconds: int = 3600, quiet_hours: float = 6, patients_per_nurse: int = 5, shift_hours: int = 12) -> DataFrame:
    """Alerts a nurse and shift of the log from `start` on. Earlier steps tell whether a stay was high already."""
    begin = F.lit(start).cast("timestamp")
    fired = sliced(alerts.onsets(log, step_seconds, quiet_hours).where(F.col("at") >= begin)).groupBy("slice").agg(F.count("*").alias("alerts"))
    steps = sliced(log.where(F.col("at") >= begin)).groupBy("slice").agg(F.count("*").alias("n"))
    load = F.when(F.col("n") >= metrics.MIN_VALUES, F.coalesce("alerts", F.lit(0)) * patients_per_nurse * shift_hours / F.col("n"))
    return signal_rows(steps.join(fired, "slice", "left"), "alerts_per_nurse_shift", load, F.col("n"), F.col("slice"))


def performance(labelled: DataFrame, reference: Mapping[str, float], step_seconds: int = 3600, replicates: int = 200, seed: int = 1) -> DataFrame:
    """Drop of AUPRC and rise of Brier beside the reference, as far as they are sure: from the far ends of intervals over
    resampled stays. The rows have stay, at, risk and label."""
    runs = alerts.episodes(labelled.withColumn("high", F.lit(True)), "label", step_seconds).agg(F.count("*").alias("runs"))
    point = metrics.ranking_quality(labelled, "risk", "label").select("auprc", "brier")
    weights = metrics.resampled(labelled.select("stay").distinct(), "stay", replicates, seed).where("weight > 0")
    drawn = metrics.ranking_quality(labelled.join(weights, "stay"), "risk", "label", ["replicate"], "weight").where("positives > 0 AND positives < n")
    ends = drawn.agg(F.percentile("auprc", F.lit(SURE)).alias("most"), F.percentile("brier", F.lit(1 - SURE)).alias("least"))
    row = runs.crossJoin(point).crossJoin(ends)  # one row each
    enough, zero = F.col("runs") >= MIN_RUNS, F.lit(0.0)
    drop = F.when(enough, F.greatest(1 - F.col("most") / reference["auprc"], zero))
    rise = F.when(enough, F.greatest(F.col("least") / reference["brier"] - 1, zero))
    parts = [
        signal_rows(row, name, value, F.col("runs"), F.lit(ALL), None, F.when(enough, F.col(kind)), F.lit(reference[kind]))
        for name, value, kind in (("auprc_drop", drop, "auprc"), ("brier_rise", rise, "brier"))
    ]
    return parts[0].unionByName(parts[1])


def without_faults(readings: DataFrame, faults: Sequence[tuple[str, str]], ts: str, before_hours: int = 1) -> DataFrame:
    """Readings behind steps that no known fault covers: those in [from - before_hours, to) are left out, everywhere."""
    for start, end in faults:
        first = F.lit(start).cast("timestamp") - F.expr(f"INTERVAL {before_hours} HOURS")
        readings = readings.where(~((F.col(ts).cast("timestamp") >= first) & (F.col(ts).cast("timestamp") < F.lit(end).cast("timestamp"))))
    return readings


def data_quality(reference: DataFrame, current: DataFrame, quarantined: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of readings in quarantine, and how far each field's missing share has moved."""
    shares = lambda rows, tag: rows.agg(F.count("*").alias(f"n_{tag}"), *[F.coalesce(F.avg(F.col(f).isNull().cast("double")), F.lit(0.0)).alias(f"{f}_{tag}") for f in fields])
    row = shares(reference, "then").crossJoin(shares(current, "now")).crossJoin(quarantined.agg(F.count("*").alias("held")))  # one row each
    total = F.col("n_now") + F.col("held")
    enough = total >= metrics.MIN_VALUES
    out = signal_rows(row, "quarantine_rate", F.when(enough, F.col("held") / total), total, F.lit(ALL))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_now").alias("now"), F.col(f"{f}_then").alias("was")) for f in fields])).alias("f")
    moved = row.select(F.col("n_now"), enough.alias("enough"), each)
    change, now = (F.when(F.col("enough"), x) for x in (F.abs(F.col("f.now") - F.col("f.was")), F.col("f.now")))
    return out.unionByName(signal_rows(moved, "missing_rate_change", change, F.col("n_now"), F.lit(ALL), F.col("f.field"), now, F.col("f.was")))


def summary(signals: DataFrame) -> DataFrame:
    """One row: status (the worst level), n_warn, n_act, breaches (worst first) and kinds of those that ask for action."""
    name = F.concat_ws(" ", "signal", F.when(F.col("feature").isNotNull(), F.concat(F.lit("("), "feature", F.lit(")"))), F.when(F.col("site") != ALL, F.concat(F.lit("at "), "site")))
    acts = F.col("level") == "act"
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("signal")), F.lit("other"))
    where = F.when(F.col("site") == ALL, kind).otherwise(F.concat_ws("@", kind, F.col("site")))
    breach = F.struct(F.when(acts, 0).otherwise(1).alias("rank"), (-F.col("value")).alias("size"), F.concat_ws(": ", name, F.col("level")).alias("text"))
    out = signals.agg(
        F.count_if(F.col("level") == "warn").alias("n_warn"), F.count_if(acts).alias("n_act"),
        F.array_sort(F.collect_list(F.when(F.col("level").isin("warn", "act"), breach))).alias("breaches"), F.array_sort(F.collect_set(F.when(acts, where))).alias("kinds"),
    )
    status = F.when(F.col("n_act") > 0, "act").when(F.col("n_warn") > 0, "warn").otherwise("stable")
    return out.select(status.alias("status"), "n_warn", "n_act", F.transform("breaches", lambda b: b["text"]).alias("breaches"), "kinds")


def cross_check(signals: DataFrame, monitor: DataFrame, version: str) -> DataFrame:
    """How far another monitor's numbers (signals named lm_...) are from ours, relative, where both have one: alert loads at
    all sites, and the distance of all predictions on a day that this version scored, whose logarithms are natural there."""
    ours = signals.where("value IS NOT NULL AND (signal = 'alerts_per_nurse_shift' OR (signal = 'prediction_js' AND site = 'all'))")
    theirs = monitor.where(F.col("value").isNotNull() & ((F.col("signal") == "lm_alerts_per_nurse_shift") | ((F.col("signal") == "lm_prediction_js") & (F.col("feature") == f"v{version}"))))
    theirs = theirs.select(F.expr("substr(signal, 4)").alias("signal"), "site", F.col("value").alias("monitor"))
    expected = F.col("value") * F.when(F.col("signal") == "prediction_js", NATURAL).otherwise(1.0)
    both = ours.select("signal", "site", "value", "n").join(theirs, ["signal", "site"]).withColumn("expected", expected)
    difference = F.abs(F.col("monitor") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1e-9))
    return signal_rows(both, "monitor_difference", difference, F.col("n"), F.col("site"), F.col("signal"), F.col("monitor"), F.col("expected"))


class MonitorBehind(RuntimeError):
    """The monitor's latest day ends before the data."""


def monitor_signals(profile: DataFrame, drift: DataFrame, end: str, step_seconds: int = 3600) -> DataFrame:
    """Another monitor's numbers for the latest whole day and week that end by `end`, as signals that are not judged.

    profile: granularity, window_start, window_end, model_version ("*" for all), slice_key, slice_value, count,
    alerts_per_nurse_shift, auprc, brier, auroc. drift: granularity, window_end, model_version, slice_key, slice_value,
    js_distance. Predictions are those of the version with most rows on the day. A day that no window covers is an error.
    """
    until = F.lit(end).cast("timestamp")
    last = until - F.expr(f"INTERVAL {step_seconds} SECONDS")
    covered = profile.where((F.col("granularity") == "1 day") & (F.col("window_start") <= last) & (F.col("window_end") > last))
    if covered.isEmpty():
        latest = profile.where("granularity = '1 day'").agg(F.max("window_end")).first()[0]
        raise MonitorBehind(f"the latest day of the monitor ends at {latest}, the data at {end}: score the new steps before the check")

    def latest_of(rows: DataFrame, granularity: str, by: Sequence[str] = ()) -> DataFrame:
        some = rows.where((F.col("granularity") == granularity) & (F.col("window_end") <= until)).where("slice_key IS NULL OR slice_key = 'site_id'")
        newest = F.max("window_end").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))  # the rows of a few windows
        return some.withColumn("_newest", newest).where("window_end = _newest").withColumn("site", F.when(F.col("slice_key").isNull(), ALL).otherwise(F.col("slice_value")))

    def shadow(rows: DataFrame, name: str, value: str, n: str, feature: Column | None = None) -> DataFrame:
        return signal_rows(rows, name, F.col(value), F.col(n), F.col("site"), feature).withColumn("level", F.lit("shadow"))

    day, week = latest_of(profile, "1 day"), latest_of(profile, "1 week").where("model_version = '*'")
    out = shadow(day.where("model_version = '*'"), "lm_alerts_per_nurse_shift", "alerts_per_nurse_shift", "count")
    own = day.where("model_version <> '*'")
    most = own.where("slice_key IS NULL").agg(F.max_by("model_version", F.struct("count", "model_version")).alias("model_version"))
    counts = own.join(F.broadcast(most), "model_version").select("model_version", "site", F.col("count").alias("rows"))  # one row is broadcast
    js = latest_of(drift, "1 day", ["model_version"]).join(F.broadcast(most), "model_version").join(counts, ["model_version", "site"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    out = out.unionByName(shadow(js, "lm_prediction_js", "js_distance", "rows", F.concat(F.lit("v"), "model_version")))
    for name in ("auprc", "brier", "auroc"):
        out = out.unionByName(shadow(week, f"lm_{name}_week", name, "count"))
    return out
