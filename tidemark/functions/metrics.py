"""Quality of scores against labels, and distances between distributions. All grouped by any columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import dense_number, in_ranges, running_sum
from tidemark.session import checkpointed


def ranking_quality(rows: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """auroc, auprc, brier, n and positives of each group; tied scores count as one threshold. Rows count `weight` times.

    Rows are first added up by score, then two running sums over the distinct scores give all there is to know. One
    class alone has no auroc, no positives no auprc.
    """
    by = list(by) or ["_all"]
    rows = rows.withColumn("_all", F.lit(1)) if by == ["_all"] else rows
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    one, times = F.col(label).cast("double"), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    steps = known.groupBy(*by, score).agg(F.sum(times * one).alias("pos"), F.sum(times * (1 - one)).alias("neg"), F.sum(times * (F.col(score) - one) ** 2).alias("error"))
    steps = running_sum(steps, [F.desc(score)], by, ["pos", "neg"])
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = steps.groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum("error").alias("error"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)).alias("wins"), F.sum(F.col("pos") * precision).alias("area"),
    )
    return sums.select(
        *[b for b in by if b != "_all"], F.try_divide("wins", F.col("p") * F.col("q")).alias("auroc"), F.try_divide("area", "p").alias("auprc"),
        F.try_divide("error", F.col("p") + F.col("q")).alias("brier"), (F.col("p") + F.col("q")).cast("long").alias("n"), F.col("p").cast("long").alias("positives"),
    )


def at_top(rows: DataFrame, score: str, label: str, tie: str, share: float) -> DataFrame:
    """precision and recall of the top share of rows, at least one; ties in the order of `tie`."""
    ranked = dense_number(rows, [F.desc(score), F.col(tie)], "_rank")
    totals = rows.agg(F.greatest(F.lit(1), F.round(F.count("*") * share)).alias("_k"), F.sum(label).alias("_pos"))
    top = ranked.crossJoin(F.broadcast(totals)).where("_rank <= _k")  # one row
    hits = F.sum(label)
    return top.agg((hits / F.count("*")).alias("precision"), F.try_divide(hits, F.max("_pos")).alias("recall"))


def calibration(rows: DataFrame, score: str, label: str, tie: str, bins: int = 10) -> DataFrame:
    """bin, mean score, mean label, n of equal-count bins by rank; the first bins take what is left over."""
    ranked = dense_number(rows, [F.col(score), F.col(tie)], "_rank")
    n = F.broadcast(rows.agg(F.count("*").alias("_n")))  # one row
    size, over = F.floor(F.col("_n") / bins), F.col("_n") % bins
    wide = (size + 1) * over
    place = F.col("_rank") - 1
    number = F.when(place < wide, F.floor(place / (size + 1))).otherwise(over + F.floor((place - wide) / F.greatest(size, F.lit(1))))
    out = ranked.crossJoin(n).withColumn("bin", number.cast("int") + 1)
    return out.groupBy("bin").agg(F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"), F.count("*").alias("n"))


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The `by` columns and `quantiles`: an array of exact quantiles of the values there are, interpolated linearly.

    Values lie in ranges of their order; what stands before a range in its group is a sum over ranges, so a value's place is
    known where it lies, and no task holds all values of a group.
    """
    keys = list(by) or ["_all"]
    rows = rows.withColumn("_all", F.lit(1)) if keys == ["_all"] else rows
    dealt = in_ranges(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value")), [*keys, "_value"])
    sizes = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_own").alias("_first"))
    group = Window.partitionBy(*keys)  # a row for each range that the group lies in
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "_total": F.sum("_n").over(group)})
    same = F.col("d._part") == F.col("s._part")
    for k in keys:
        same &= F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}"))
    placed = dealt.alias("d").join(sizes.alias("s"), same).select(*[F.col(f"d.{k}") for k in keys], "_value", "_total", (F.col("_before") + F.col("_own") - F.col("_first")).alias("_place"))
    places = [F.lit(float(s)) * (F.col("_total") - 1) for s in shares]
    wanted = F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)])

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_place") == place, F.col("_value")))

    found = placed.where(F.array_contains(wanted, F.col("_place"))).groupBy(*keys).agg(
        *[at(F.floor(p)).alias(f"_low{i}") for i, p in enumerate(places)], *[at(F.ceil(p)).alias(f"_high{i}") for i, p in enumerate(places)],
        *[F.max(p - F.floor(p)).alias(f"_rest{i}") for i, p in enumerate(places)],
    )
    each = [F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_rest{i}") for i in range(len(shares))]
    return found.select(*by, F.array(*each).alias("quantiles"))


def quantile(rows: DataFrame, score: str, share: float) -> DataFrame:
    """One row: the exact quantile, interpolated linearly."""
    return quantiles(rows, score, [share]).select(F.col("quantiles")[0].alias("threshold"))


#: Bins' shares are at least this before they are made to add up again; with fewer values there is no distance.
FLOOR, MIN_VALUES = 1e-4, 500


def distances(baseline: DataFrame, current: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """psi and js of each group: baseline deciles as edges, bins [edge, next), open at both ends.

    The edges are a row for each group; both sides are counted by bin in one pass each.
    """
    by = list(by) or ["_all"]
    if by == ["_all"]:
        baseline, current = (x.withColumn("_all", F.lit(1)) for x in (baseline, current))
    # a row for each group, which three plans read
    edges = checkpointed(quantiles(baseline, value, [i / 10 for i in range(1, 10)], by).select(*by, F.array_distinct("quantiles").alias("edges")), "edges")

    def shares(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.where(F.col(value).isNotNull()).join(edges, by)
        bins = F.size(F.filter("edges", lambda e: e <= F.col(value)))
        return rows.groupBy(*by, bins.alias("bin")).agg(F.count("*").alias(name))

    every = edges.select(*by, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    counts = every.join(shares(baseline, "a"), [*by, "bin"], "left").join(shares(current, "b"), [*by, "bin"], "left").fillna(0, ["a", "b"])
    group = Window.partitionBy(*by)  # eleven rows at most
    for c in ("a", "b"):
        counts = counts.withColumn(f"n_{c}", F.sum(c).over(group)).withColumn(c, F.greatest(F.try_divide(c, f"n_{c}"), F.lit(FLOOR)))
    counts = counts.withColumns({c: F.col(c) / F.sum(c).over(group) for c in ("a", "b")})
    a, b = F.col("a"), F.col("b")
    middle = (a + b) / 2
    out = counts.groupBy(*by).agg(
        F.sum((b - a) * F.ln(b / a)).alias("psi"),
        F.sqrt(F.sum(a * F.log2(a / middle) + b * F.log2(b / middle)) / 2).alias("js"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"),
    )
    enough = (F.col("n_a") >= MIN_VALUES) & (F.col("n_b") >= MIN_VALUES)
    return out.select(*[x for x in by if x != "_all"], F.when(enough, F.col("psi")).alias("psi"), F.when(enough, F.col("js")).alias("js"), F.col("n_b").alias("n"))


#: Fixed values: (warn, act) of each drift signal.
LIMITS = {
    "feature_psi": (0.1, 0.2),
    "prediction_js": (0.08, 0.12),
    "alerts_per_nurse_shift": (2.5, 3.0),
    "auprc_drop": (0.10, 0.20),
    "brier_rise": (0.10, 0.20),
    "quarantine_rate": (0.02, 0.05),
    "missing_rate_change": (0.02, 0.05),
    "monitor_difference": (0.01, float("inf")),
}
LEVELS = ("act", "warn", "stable", "not enough data")


def level(signal: Column, value: Column) -> Column:
    """act, warn or stable by the signal's limits; "not enough data" for a null."""
    out = F.lit(None).cast("string")
    for name, (warn, act) in LIMITS.items():
        here = F.when(value.isNull(), "not enough data").when(value >= act, "act").when(value >= warn, "warn").otherwise("stable")
        out = F.when(signal == name, here).otherwise(out)
    return out


def worst_first(signals: DataFrame) -> DataFrame:
    """The signals with their `place`: those that ask for action first, then by value, then by their other columns."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    rest = [F.asc_nulls_last(c) for c in signals.columns if c not in {"level", "value"}]
    return dense_number(signals.withColumn("_rank", rank), [F.col("_rank"), F.desc_nulls_last("value"), *rest], "place").drop("_rank")


#: exp(-1): the share of stays that a replicate does not draw.
POISSON = 0.36787944117144233


def resampled(stays: DataFrame, stay: str, replicates: int, seed: int = 1) -> DataFrame:
    """Each stay with its weight in each replicate: Poisson(1) from hashes, so whole stays are drawn, with no exchange.

    An approximation of drawing as many stays as there are, with replacement; weights are the same at each run, and any
    engine with MD5 gives the same.
    """
    name = F.concat_ws(":", F.col(stay).cast("string"), F.col("replicate").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight, total, term = F.lit(0), 0.0, POISSON
    for k in range(1, 9):
        total += term
        weight = weight + F.when(u >= total, 1).otherwise(0)
        term /= k
    return stays.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("weight", weight)


def interval(rows: DataFrame, by: Sequence[str], value: str, coverage: float = 0.95) -> DataFrame:
    """lo and hi: percentiles of the value over replicates."""
    edge = (1 - coverage) / 2
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(edge)).alias("lo"), F.percentile(value, F.lit(1 - edge)).alias("hi"))


def paired_difference(rows: DataFrame, by: Sequence[str], value: str, other: str) -> DataFrame:
    """Of two values measured on the same replicates: the interval of their difference, and the share in which the first is larger."""
    change = rows.withColumn("_change", F.col(value) - F.col(other))
    better = change.groupBy(*by).agg(F.avg("_change").alias("mean"), F.avg((F.col("_change") > 0).cast("double")).alias("share_better"))
    return interval(change, by, "_change").join(better, list(by))
