"""Summaries: counts, shares, pivots, roll-ups of event logs, versions and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import bands, metrics, ranking
from tidemark.plans import signals
from tidemark.plans.catalogue import register
from tidemark.sources.tables import table


@register("flag_reference", "SELECT 'brass' AS flag, count(DISTINCT p_brand) AS brands, count(*) AS n FROM part WHERE regexp_matches(lower(p_type), 'brass') UNION ALL SELECT 'steel', count(DISTINCT p_brand), count(*) FROM part WHERE regexp_matches(lower(p_type), 'steel')")
def flag_reference(spark, sf_dir):
    """A row for each flag: a case-insensitive pattern over descriptions, as a union of selects."""
    part, out = table(spark, sf_dir, "part"), None
    for flag in ("brass", "steel"):
        found = part.where(F.col("p_type").rlike(f"(?i){flag}")).agg(F.lit(flag).alias("flag"), F.countDistinct("p_brand").alias("brands"), F.count("*").alias("n"))
        out = found if out is None else out.unionByName(found)
    return out.orderBy("flag")


@register("any_flags", "SELECT o_custkey, bool_or(o_orderpriority ILIKE '%urgent%') AS urgent, bool_or(o_orderstatus = 'F') AS closed, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def any_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority").rlike("(?i)urgent")).alias("urgent"), F.bool_or(F.col("o_orderstatus") == "F").alias("closed"), F.count("*").alias("n"))


@register(
    "rule_rollup",
    "SELECT user_id % 5 AS run, 'k' AS rule, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY 1 UNION ALL SELECT user_id % 5, 'one', CAST(count(*) AS BIGINT) FROM events GROUP BY 1",
)
def rule_rollup(spark, sf_dir):
    """An event log of JSON arrays of rules, exploded and added up."""
    detail = F.to_json(F.array(F.struct(F.lit("k").alias("rule"), F.get_json_object("props", "$.k").cast("int").alias("n")), F.struct(F.lit("one").alias("rule"), F.lit(1).alias("n"))))
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("run"), F.to_json(F.struct(F.struct(detail.alias("rules")).alias("flow"))).alias("details"))
    parsed = F.from_json(F.get_json_object("details", "$.flow.rules"), "array<struct<rule:string,n:int>>")
    return log.select("run", F.explode(parsed).alias("r")).groupBy("run", "r.rule").agg(F.sum("r.n").alias("total"))


@register(
    "version_summary",
    "SELECT user_id % 4 AS model_version, min(ts) AS first_at, max(ts) AS last_at, round(avg(CASE WHEN value >= 60 THEN 100.0 ELSE 0 END), 4) AS high_percent, min(CASE WHEN value >= 60 THEN value END) AS threshold FROM events GROUP BY 1",
)
def version_summary(spark, sf_dir):
    high = F.col("value") >= 60
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("model_version")).agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.round(F.avg(F.when(high, 100.0).otherwise(0.0)), 4).alias("high_percent"), F.min(F.when(high, F.col("value"))).alias("threshold")
    )


@register("repeated_keys", "SELECT l_orderkey, l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@register("latest_by_max", "SELECT event_type, max_by(event_id, ts) AS last_id, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high FROM events GROUP BY 1")
def latest_by_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", "ts").alias("last_id"), F.count_if(F.col("value") > 50).alias("high"))


@register("full_hour", "WITH c AS (SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS census FROM events GROUP BY 1) SELECT max(hour) AS hour FROM c WHERE census >= 0.5 * (SELECT median(census) FROM c)")
def full_hour(spark, sf_dir):
    """The last hour with at least half the usual number of entities."""
    census = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.countDistinct("user_id").alias("census"))
    usual = census.agg(F.median("census").alias("usual"))
    return census.crossJoin(F.broadcast(usual)).where("census >= 0.5 * usual").agg(F.max("hour").alias("hour"))  # one row


@register(
    "distance_pivot",
    """
    WITH b AS (SELECT l_returnflag AS flag, l_quantity AS v FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey % 2 = 0), c AS (SELECT l_returnflag AS flag, l_quantity AS v FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey % 2 = 1)
    SELECT CAST(count(*) AS BIGINT) AS flags FROM (SELECT flag FROM b GROUP BY 1 HAVING count(*) >= 500 INTERSECT SELECT flag FROM c GROUP BY 1 HAVING count(*) >= 500)
    """,
)
def distance_pivot(spark, sf_dir):
    """PSI of each flag as a column, then the number of those there are enough values for."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_returnflag").alias("flag"), "l_orderkey", F.col("l_quantity").alias("v"))
    found = metrics.distances(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1"), "v", ["flag"])
    wide = found.groupBy().pivot("flag", ["A", "N", "R"]).agg(F.first("psi"))
    return wide.select(sum((F.col(c).isNotNull().cast("long") for c in ("A", "N", "R")), F.lit(0)).alias("flags"))


@register("collected_json", "SELECT c_nationkey, '[' || string_agg('{\"k\":' || c_custkey || '}', ',' ORDER BY c_custkey) || ']' AS members FROM customer GROUP BY 1")
def collected_json(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"))))).alias("members"))


@register("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@register("risk_deciles", "WITH e AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lineitem) SELECT 'd' || len(list_filter(q, lambda x: x <= l_extendedprice)) AS decile, CAST(count(*) AS BIGINT) AS n FROM lineitem, e GROUP BY 1")
def risk_deciles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    edges = metrics.quantiles(lines, "l_extendedprice", [i / 10 for i in range(1, 10)]).withColumnRenamed("quantiles", "q")
    placed = lines.crossJoin(F.broadcast(edges))  # one row
    return placed.groupBy(F.concat(F.lit("d"), F.size(F.filter("q", lambda e: e <= F.col("l_extendedprice"))).cast("string")).alias("decile")).agg(F.count("*").alias("n"))


@register(
    "worst_signals",
    """
    WITH s AS (SELECT event_id, value, CASE WHEN value / 100 >= 0.2 THEN 'act' WHEN value / 100 >= 0.1 THEN 'warn' ELSE 'stable' END AS level FROM events)
    SELECT event_id, value, level, row_number() OVER (ORDER BY CASE level WHEN 'act' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, value DESC, event_id) AS place FROM s
    """,
)
def worst_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", metrics.level(F.lit("feature_psi"), F.col("value") / 100).alias("level"))
    return metrics.worst_first(rows)


def _interval_sql() -> str:
    from tidemark.plans.checks import weights_sql

    return f"""
    WITH RECURSIVE {signals.LOG}, stays AS (SELECT stay, count(*) AS n, count(*) FILTER (WHERE high) AS high FROM log GROUP BY 1), w AS ({weights_sql('stay', 100)}),
    r AS (SELECT replicate, sum(weight * high) / sum(weight * n) AS share FROM w JOIN stays USING (stay) GROUP BY 1)
    SELECT 'share_high' AS metric, round(quantile_cont(share, 0.025), 6) AS lo, round(quantile_cont(share, 0.975), 6) AS hi FROM r
    """


@register("bootstrap_interval", _interval_sql())
def bootstrap_interval(spark, sf_dir):
    """Percentile interval of the share of high days, whole stays resampled."""
    log = signals.score_log(spark, sf_dir)
    stays = log.groupBy("stay").agg(F.count("*").alias("n"), F.count_if("high").alias("high"))
    weighted = metrics.resampled(stays, "stay", 100)
    shares = weighted.groupBy("replicate").agg((F.sum(F.col("weight") * F.col("high")) / F.sum(F.col("weight") * F.col("n"))).alias("share")).withColumn("metric", F.lit("share_high"))
    return metrics.interval(shares, ["metric"], "share").select("metric", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("plain_score", "SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) - 0.001 * coalesce(l_tax, 100), 8) AS score FROM lineitem")
def plain_score(spark, sf_dir):
    """A rule-based score, with a tie-breaker, as a ranking score."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.coalesce("l_quantity", F.lit(0.0)) - 0.001 * F.coalesce("l_tax", F.lit(100.0)), 8).alias("score"))


@register("seeded_sample", "SELECT event_id FROM events ORDER BY md5(event_id || ':7'), event_id LIMIT 200")
def seeded_sample(spark, sf_dir):
    return ranking.hashed_sample(table(spark, sf_dir, "events").select("event_id"), "event_id", 7, 200)


@register("age_sum_bands", "SELECT CASE WHEN p_size < 18 THEN NULL WHEN p_size < 50 THEN '18-49' ELSE '50-69' END AS band, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def age_sum_bands(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(bands.age_band(F.col("p_size")).alias("band")).agg(F.count("*").alias("n"))
