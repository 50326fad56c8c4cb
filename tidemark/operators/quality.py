"""Row rules: which rows pass, which rules the others break, and the books that must balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.history import first_copy


def within(column: str, low: float, high: float) -> str:
    """A rule for a value that may be absent: in the closed range."""
    return f"({column} IS NULL OR {column} BETWEEN {low} AND {high})"


def present(*columns: str) -> str:
    """A rule: none of the columns is null."""
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def one_of(column: str, *values: str) -> str:
    """A rule that is false, not null, for an absent value."""
    return f"coalesce({column} IN ({', '.join(repr(v) for v in values)}), false)"


def failed_rules(rules: Mapping[str, str]) -> Column:
    """Names of the rules that a row breaks; an undecided rule is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def valid(rows: DataFrame, rules: Mapping[str, str], observation: Observation | None = None) -> DataFrame:
    """The rows that keep every rule; counts of broken rules go to the observation as the rows pass by."""
    if observation is not None:
        rows = rows.observe(observation, *[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()])
    return rows.where(F.size(failed_rules(rules)) == 0)


def quarantine(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """The other rows, with the names of the rules they break."""
    return rows.withColumn("failed_rules", failed_rules(rules)).where("size(failed_rules) > 0")


def rule_report(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """rule, failed, passed: all rules in one pass, then a row each."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed"), (F.col("n") - F.col(n)).alias("passed")) for n in rules]))
    return counts.select(each.alias("r")).select("r.*")


def missing_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, share of nulls: one pass for all columns."""
    shares = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns]))
    return shares.select(each.alias("r")).select("r.*")


def reconcile(raw: DataFrame, stored: DataFrame, linked: DataFrame, rules: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """One row of counts: raw = quarantined + duplicates + stored + missing, and stored = linked + unlinked."""
    good = valid(raw, rules).select(*keys)
    unique = good.distinct()
    one = raw.agg(F.count("*").alias("raw"), F.count_if(F.size(failed_rules(rules)) > 0).alias("quarantined"))
    for frame, name in ((good, "good"), (unique, "unique_good"), (stored, "stored"), (linked.select(*keys).distinct(), "linked"), (unique.join(stored, list(keys), "left_anti"), "missing")):
        one = one.crossJoin(frame.agg(F.count("*").alias(name)))  # one row each
    return one.select("raw", "quarantined", (F.col("good") - F.col("unique_good")).alias("duplicates"), "missing", "stored", "linked", (F.col("stored") - F.col("linked")).alias("unlinked"))


def deduplicated(rows: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row of each key: any, or the first in an order."""
    return rows.dropDuplicates(list(keys)) if order is None else first_copy(rows, keys, order)


def require_current(upstream: DataFrame, downstream: DataFrame, ts: str) -> None:
    """Raises if the downstream table ends in an earlier hour than the upstream one. Both empty is fine."""
    ends = [frame.agg(F.max(F.date_trunc("hour", ts)).alias("end")).first()["end"] for frame in (upstream, downstream)]
    if ends[0] is not None and (ends[1] is None or ends[1] < ends[0]):
        raise ValueError(f"downstream ends at {ends[1]}, upstream at {ends[0]}: run it first")
