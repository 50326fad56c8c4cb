"""Queries on scores: bands, labels, alerts, facts, quality of ranking, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import bands, metrics, ranking
from tidemark.operators import alerts
from tidemark.plans.catalogue import register
from tidemark.plans.timeline import ONSETS
from tidemark.sources.tables import table

DAY = 86400


def score_log(spark, sf_dir):
    """A daily log from events: the largest value of a user's day, as risk; high from 0.6 on."""
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    days = events.groupBy(F.col("user_id").alias("stay"), F.date_trunc("day", "ts").alias("at")).agg(F.max("value").alias("top"), F.count("*").alias("n"))
    risk = F.round(F.least(F.col("top") / 100, F.lit(1.0)), 6)
    return days.select("stay", "at", (F.col("stay") % 3).alias("site"), (F.col("stay") % 7).alias("unit"), risk.alias("risk"), F.col("n").cast("double").alias("score"), (risk >= 0.6).alias("high"))


def outcomes(spark, sf_dir):
    """Error events as outcomes."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("stay"), F.col("ts").cast("timestamp").alias("event_at"))


LOG = """log AS (
        SELECT user_id AS stay, date_trunc('day', ts) AS day_at, user_id % 3 AS site, user_id % 7 AS unit, round(least(max(value) / 100, 1.0), 6) AS risk,
               CAST(count(*) AS DOUBLE) AS score, round(least(max(value) / 100, 1.0), 6) >= 0.6 AS high
        FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3, 4
    ), outcomes AS (SELECT user_id AS stay, ts AS event_at FROM events WHERE event_type = 'error'),
    entered AS (
        SELECT *, row_number() OVER (PARTITION BY stay ORDER BY day_at) AS rn FROM (
            SELECT *, lag(high) OVER w AS high_before, lag(day_at) OVER w AS before FROM log WINDOW w AS (PARTITION BY stay ORDER BY day_at))
        WHERE high AND NOT coalesce(high_before AND day_at - before = INTERVAL 1 DAY, false)
    ), fired AS (
        SELECT stay, day_at, rn, day_at AS fired_at, true AS fires FROM entered WHERE rn = 1
        UNION ALL
        SELECT e.stay, e.day_at, e.rn, CASE WHEN e.day_at - f.fired_at >= INTERVAL 72 HOUR THEN e.day_at ELSE f.fired_at END, e.day_at - f.fired_at >= INTERVAL 72 HOUR
        FROM fired f JOIN entered e ON e.stay = f.stay AND e.rn = f.rn + 1
    ), onsets AS (SELECT l.* FROM fired f JOIN log l USING (stay, day_at) WHERE fires),
    first_events AS (SELECT stay, min(event_at) AS event_at FROM outcomes GROUP BY 1),
    alerts AS (
        SELECT CAST(stay AS VARCHAR) || '@' || strftime(day_at, '%Y%m%dT%H') AS alert_id, o.stay, site, unit, day_at AS alert_at, risk,
               CASE WHEN event_at > day_at AND event_at <= day_at + INTERVAL 72 HOUR THEN 1 WHEN day_at + INTERVAL 72 HOUR <= TIMESTAMP '2024-01-25' THEN 0 END AS escalated,
               CASE WHEN event_at > day_at AND event_at <= day_at + INTERVAL 72 HOUR THEN round(epoch(event_at - day_at) / 3600, 4) END AS hours_to_event
        FROM onsets o LEFT JOIN first_events USING (stay)
    )"""
KNOWN = "2024-01-25"


def alert_rows(spark, sf_dir):
    """Alerts of the daily log."""
    return alerts.alerts(score_log(spark, sf_dir), outcomes(spark, sf_dir), KNOWN, DAY, 72)


@register("score_log", f"WITH RECURSIVE {LOG} SELECT stay, day_at, site, unit, risk, score, high FROM log")
def score_log_query(spark, sf_dir):
    return score_log(spark, sf_dir).withColumnRenamed("at", "day_at")


@register("alerts_fact", f"WITH RECURSIVE {LOG} SELECT * FROM alerts")
def alerts_fact(spark, sf_dir):
    return alert_rows(spark, sf_dir).drop("score").withColumn("hours_to_event", F.round("hours_to_event", 4))


@register(
    "escalations_fact",
    f"""
    WITH RECURSIVE {LOG}
    SELECT o.stay, event_at, max_by(risk, day_at) AS risk_before, max_by(site, day_at) AS site, max_by(unit, day_at) AS unit,
           count(*) FILTER (WHERE high AND day_at >= event_at - INTERVAL 72 HOUR) > 0 AS flagged,
           round(epoch(event_at - min(day_at) FILTER (WHERE high AND day_at >= event_at - INTERVAL 72 HOUR)) / 3600, 4) AS hours_flagged
    FROM outcomes o JOIN log l ON o.stay = l.stay AND day_at < event_at WHERE event_at <= TIMESTAMP '2024-01-25' GROUP BY 1, 2
    """,
)
def escalations_fact(spark, sf_dir):
    rows = alerts.escalations(score_log(spark, sf_dir), outcomes(spark, sf_dir), KNOWN, 72)
    return rows.withColumn("hours_flagged", F.round("hours_flagged", 4)).select("stay", "event_at", "risk_before", "site", "unit", "flagged", "hours_flagged")


@register(
    "kpi_cube",
    f"""
    WITH RECURSIVE {LOG}, base AS (
        SELECT site, unit, day_at, CAST(count(DISTINCT stay) AS BIGINT) AS census, CAST(count(*) FILTER (WHERE high) AS BIGINT) AS n_high,
               CAST(count(*) FILTER (WHERE NOT high) AS BIGINT) AS n_low, round(avg(score), 4) AS mean_score FROM log GROUP BY 1, 2, 3
    ), raised AS (SELECT site, unit, alert_at AS day_at, count(*) AS n FROM alerts GROUP BY 1, 2, 3),
    placed AS (
        SELECT l.site, l.unit, date_trunc('day', o.event_at) AS day_at, count(*) AS n
        FROM (SELECT *, date_trunc('day', event_at) AS slot FROM outcomes) o ASOF JOIN log l ON o.stay = l.stay AND o.slot >= l.day_at GROUP BY 1, 2, 3
    )
    SELECT site, unit, day_at, census, n_high, n_low, mean_score, CAST(coalesce(raised.n, 0) AS BIGINT) AS alerts, CAST(coalesce(placed.n, 0) AS BIGINT) AS escalations
    FROM base LEFT JOIN raised USING (site, unit, day_at) LEFT JOIN placed USING (site, unit, day_at)
    """,
)
def kpi_cube(spark, sf_dir):
    cube = alerts.kpis(score_log(spark, sf_dir), alert_rows(spark, sf_dir), outcomes(spark, sf_dir), "day")
    return cube.withColumn("mean_score", F.round("mean_score", 4)).withColumnRenamed("at", "day_at")


@register(
    "delayed_labels",
    f"""
    WITH RECURSIVE {LOG}, now AS (SELECT TIMESTAMP '2024-01-25' AS t), j AS (
        SELECT l.stay, l.day_at, min(o.event_at + INTERVAL 24 HOUR) AS recorded_at FROM log l LEFT JOIN (SELECT * FROM outcomes, now WHERE event_at + INTERVAL 24 HOUR <= t) o
          ON l.stay = o.stay AND o.event_at > l.day_at AND o.event_at <= l.day_at + INTERVAL 72 HOUR GROUP BY 1, 2
    )
    SELECT stay, day_at, CASE WHEN recorded_at IS NOT NULL THEN 1 ELSE 0 END AS label, coalesce(recorded_at, day_at + INTERVAL 96 HOUR) AS known_at
    FROM j, now WHERE recorded_at IS NOT NULL OR day_at + INTERVAL 96 HOUR <= t
    """,
)
def delayed_labels(spark, sf_dir):
    return alerts.labels(score_log(spark, sf_dir), outcomes(spark, sf_dir), KNOWN, 72, 24).withColumnRenamed("at", "day_at")


@register(
    "warning_episodes",
    """
    WITH RECURSIVE """ + LOG + """, pos AS (SELECT *, lag(day_at) OVER (PARTITION BY stay ORDER BY day_at) AS p FROM log WHERE score >= 1),
    runs AS (SELECT *, sum(CASE WHEN p IS NULL OR day_at - p > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY stay ORDER BY day_at ROWS UNBOUNDED PRECEDING) AS island FROM pos)
    SELECT stay, CAST(island AS BIGINT) AS island, min(day_at) AS first_at, max(day_at) AS last_at, bool_or(high) AS caught,
           round(epoch(max(day_at) - min(day_at) FILTER (WHERE high)) / 3600 + 1, 4) AS lead_hours
    FROM runs GROUP BY 1, 2
    """,
)
def warning_episodes(spark, sf_dir):
    log = score_log(spark, sf_dir).withColumn("label", (F.col("score") >= 1).cast("int"))
    return alerts.episodes(log, "label", DAY).withColumn("lead_hours", F.round("lead_hours", 4))


@register(
    "alert_metrics",
    f"""
    WITH RECURSIVE {LOG}, pos AS (SELECT *, lag(day_at) OVER (PARTITION BY stay ORDER BY day_at) AS p FROM log WHERE score > 1),
    runs AS (SELECT *, sum(CASE WHEN p IS NULL OR day_at - p > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY stay ORDER BY day_at ROWS UNBOUNDED PRECEDING) AS island FROM pos),
    episodes AS (SELECT bool_or(high) AS caught, epoch(max(day_at) - min(day_at) FILTER (WHERE high)) / 3600 + 1 AS lead FROM runs GROUP BY stay, island)
    SELECT CAST((SELECT count(*) FROM onsets) AS BIGINT) AS alerts, round((SELECT count(*) FROM onsets) * 60.0 / (SELECT count(*) FROM log), 6) AS per_nurse_shift,
    round((SELECT avg(CASE WHEN score > 1 THEN 1.0 ELSE 0 END) FROM onsets), 6) AS precision, round((SELECT avg(CASE WHEN high THEN 1.0 ELSE 0 END) FROM log), 6) AS share_high,
    (SELECT count(*) FROM episodes) AS escalations, round((SELECT avg(caught::INT) FROM episodes), 6) AS flagged, round((SELECT median(lead) FROM episodes), 6) AS median_lead
    """,
)
def alert_metrics(spark, sf_dir):
    log = score_log(spark, sf_dir).withColumn("label", (F.col("score") > 1).cast("int"))
    row = alerts.alert_metrics(log, alerts.onsets(log, DAY, 72), "label", step_seconds=DAY)
    return row.select("alerts", "escalations", *[F.round(c, 6).alias(c) for c in ("per_nurse_shift", "precision", "share_high", "flagged", "median_lead")])


@register(
    "device_health",
    """
    WITH g AS (SELECT *, lag(ts) OVER w AS before, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g), l AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS size FROM r),
    d AS (
        SELECT user_id, date_trunc('day', ts) AS day, count(*) AS received, count(*) FILTER (WHERE ts - before >= INTERVAL 300 MINUTE) AS outages,
               count(*) FILTER (WHERE size >= 3) * 5 AS stuck_minutes, array_to_string(list_sort(list(DISTINCT event_type)), '/') AS kinds FROM l GROUP BY 1, 2
    ), e AS (SELECT DISTINCT user_id, DATE '2024-01-03' + INTERVAL 1 DAY * CAST(k AS INT) AS day, 3 AS expected FROM events, range(4) x(k))
    SELECT user_id, day, CAST(coalesce(received, 0) AS BIGINT) AS received, CAST(coalesce(expected, 0) AS BIGINT) AS expected, CAST(coalesce(outages, 0) AS BIGINT) AS outages,
           CAST(coalesce(stuck_minutes, 0) AS BIGINT) AS stuck_minutes, kinds, round(CASE WHEN expected > 0 THEN least(100.0, 100.0 * coalesce(received, 0) / expected) END, 4) AS uptime
    FROM d FULL JOIN e USING (user_id, day)
    """,
)
def device_health(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    days = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-06', INTERVAL 1 DAY)) AS day, 3L AS expected")
    expected = events.select("user_id").distinct().crossJoin(F.broadcast(days))  # four rows
    rows = alerts.device_health(events, expected, "user_id", "ts", "event_type", 300, 3)
    return rows.select("user_id", "day", "received", "expected", "outages", "stuck_minutes", "kinds", F.round("uptime", 4).alias("uptime"))


VITALS = {
    "resp_rate": "l_quantity * 0.7", "spo2": "82 + l_linenumber * 2.5", "sbp": "80 + l_extendedprice / 400",
    "heart_rate": "35 + l_quantity * 2.1", "temp_c": "34.5 + l_discount * 50",
}


def _duck_band(value: str, name: str) -> str:
    edges, points = bands.BANDS[name]
    return "CASE " + " ".join(f"WHEN {value} <= {e} THEN {p}" for e, p in zip(edges, points, strict=False)) + f" ELSE {points[-1]} END"


@register(
    "early_warning",
    f"""
    WITH v AS (
        SELECT l_orderkey, l_linenumber, round_even({VITALS['resp_rate']}, 0) AS rr, round_even({VITALS['spo2']}, 0) AS sp, round_even({VITALS['sbp']}, 0) AS bp,
               round_even({VITALS['heart_rate']}, 0) AS hr, round_even({VITALS['temp_c']}, 1) AS tc, l_linestatus = 'O' AS ox, l_returnflag = 'R' AS s2 FROM lineitem
    ), p AS (
        SELECT *, {_duck_band('rr', 'resp_rate')} AS resp_rate, {_duck_band('bp', 'sbp')} AS sbp, {_duck_band('hr', 'heart_rate')} AS heart_rate, {_duck_band('tc', 'temp_c')} AS temp_c,
               CASE WHEN s2 THEN CASE WHEN ox AND sp >= 93 THEN {_duck_band('sp', 'spo2_scale_2_on_oxygen')} ELSE {_duck_band('sp', 'spo2_scale_2')} END ELSE {_duck_band('sp', 'spo2_scale_1')} END AS spo2,
               CASE WHEN ox THEN 2 ELSE 0 END AS oxygen FROM v
    )
    SELECT l_orderkey, l_linenumber, resp_rate, spo2, sbp, heart_rate, temp_c, oxygen, resp_rate + spo2 + sbp + heart_rate + temp_c + oxygen AS total FROM p
    """,
)
def early_warning(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    vitals = {name: F.expr(sql) for name, sql in VITALS.items()}
    parts = bands.early_warning(**vitals, on_oxygen=F.col("l_linestatus") == "O", alertness=F.lit("A"), scale_2=F.col("l_returnflag") == "R")
    return lines.select("l_orderkey", "l_linenumber", *[parts[n].alias(n) for n in ("resp_rate", "spo2", "sbp", "heart_rate", "temp_c", "oxygen", "total")])


def labelled(spark, sf_dir):
    """Labelled documents with a score that ties often."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.least(F.round(F.col("n_chars") / 2000, 1), F.lit(1.0)).alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


LABELLED = "d AS (SELECT doc_id, lang, least(round(n_chars / 2000, 1), 1.0) AS score, quality FROM documents JOIN labels USING (doc_id))"


def _quality_sql(by: str) -> str:
    group, select = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    WITH {LABELLED}, s AS (SELECT {select}score, sum(quality) AS pos, sum(1 - quality) AS neg FROM d GROUP BY {select}score),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS ({part} ORDER BY score DESC)),
    r AS (SELECT {select}sum(neg * (tp - pos / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auroc, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS auprc FROM c {group}),
    b AS (SELECT {select}avg(power(score - quality, 2)) AS brier, count(*) AS n, sum(quality) AS positives FROM d {group})
    SELECT {select}round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, CAST(n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives
    FROM r {f'JOIN b USING ({by})' if by else ', b'}
    """


@register("ranking_quality", _quality_sql(""))
def ranking_quality(spark, sf_dir):
    row = metrics.ranking_quality(labelled(spark, sf_dir), "score", "quality")
    return row.select(*[F.round(c, 6).alias(c) for c in ("auroc", "auprc", "brier")], "n", "positives")


@register("ranking_quality_slices", _quality_sql("lang"))
def ranking_quality_slices(spark, sf_dir):
    row = metrics.ranking_quality(labelled(spark, sf_dir), "score", "quality", ["lang"])
    return row.select("lang", *[F.round(c, 6).alias(c) for c in ("auroc", "auprc", "brier")], "n", "positives")


@register(
    "precision_at_top",
    f"""
    WITH {LABELLED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM d), k AS (SELECT greatest(1, round(count(*) * 0.1)) AS k, sum(quality) AS pos FROM d)
    SELECT round(sum(quality) / count(*), 6) AS precision, round(sum(quality) / max(pos), 6) AS recall FROM r, k WHERE rn <= k
    """,
)
def precision_at_top(spark, sf_dir):
    row = metrics.at_top(labelled(spark, sf_dir), "score", "quality", "doc_id", 0.1)
    return row.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("calibration_bins", f"WITH {LABELLED}, r AS (SELECT *, ntile(10) OVER (ORDER BY score, doc_id) AS b FROM d) SELECT CAST(b AS INT) AS bin, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS mean_label, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1")
def calibration_bins(spark, sf_dir):
    rows = metrics.calibration(labelled(spark, sf_dir), "score", "quality", "doc_id")
    return rows.select("bin", F.round("mean_score", 6).alias("mean_score"), F.round("mean_label", 6).alias("mean_label"), "n")


@register("quantile_threshold", "SELECT round(quantile_cont(l_extendedprice, 0.93), 4) AS threshold FROM lineitem")
def quantile_threshold(spark, sf_dir):
    return metrics.quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.93).select(F.round("threshold", 4).alias("threshold"))


@register(
    "drift_distances",
    """
    WITH base AS (SELECT l_linestatus AS g, l_extendedprice AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    cur AS (SELECT l_linestatus AS g, l_extendedprice * 1.1 AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
    edges AS (SELECT g, unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM base GROUP BY 1),
    bins AS (SELECT DISTINCT g, k FROM edges, range(10) r(k)),
    ab AS (SELECT b.g, (SELECT count(*) FROM edges WHERE edges.g = b.g AND edge <= v) AS k, count(*) AS n FROM base b GROUP BY 1, 2),
    cb AS (SELECT c.g, (SELECT count(*) FROM edges WHERE edges.g = c.g AND edge <= v) AS k, count(*) AS n FROM cur c GROUP BY 1, 2),
    s AS (SELECT bins.g, greatest(coalesce(ab.n, 0) / sum(coalesce(ab.n, 0)) OVER (PARTITION BY bins.g), 1e-4) AS a, greatest(coalesce(cb.n, 0) / sum(coalesce(cb.n, 0)) OVER (PARTITION BY bins.g), 1e-4) AS b,
              sum(coalesce(cb.n, 0)) OVER (PARTITION BY bins.g) AS n FROM bins LEFT JOIN ab USING (g, k) LEFT JOIN cb USING (g, k)),
    t AS (SELECT g, a / sum(a) OVER (PARTITION BY g) AS a, b / sum(b) OVER (PARTITION BY g) AS b, n FROM s)
    SELECT g AS status, round(sum((b - a) * ln(b / a)), 5) AS psi, round(sqrt(sum(a * log2(a / ((a + b) / 2)) + b * log2(b / ((a + b) / 2))) / 2), 5) AS js, CAST(max(n) AS BIGINT) AS n FROM t GROUP BY 1
    """,
)
def drift_distances(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), "l_shipdate", F.col("l_extendedprice").alias("v"))
    edge = F.lit("1998-01-01").cast("timestamp_ntz")
    base, current = lines.where(F.col("l_shipdate") < edge), lines.where(F.col("l_shipdate") >= edge).withColumn("v", F.col("v") * 1.1)
    rows = metrics.distances(base, current, "v", ["status"])
    return rows.select("status", F.round("psi", 5).alias("psi"), F.round("js", 5).alias("js"), "n")


def _level_case(value: str) -> str:
    out = []
    for i, (_, (warn, act)) in enumerate(metrics.LIMITS.items()):
        acts = f"WHEN {value} >= {act} THEN 'act' " if act != float("inf") else ""
        out.append(f"WHEN event_id % 9 = {i} THEN CASE {acts}WHEN {value} >= {warn} THEN 'warn' ELSE 'stable' END")
    return f"CASE WHEN event_id % 50 = 0 AND event_id % 9 < 8 THEN 'not enough data' {' '.join(out)} END"


@register("drift_levels", f"SELECT event_id, {_level_case('value / 100')} AS level FROM events")
def drift_levels(spark, sf_dir):
    """Every signal's limits, a value that is missing, and a signal that there is not."""
    names = F.array(*[F.lit(n) for n in metrics.LIMITS], F.lit("another"))
    value = F.when(F.col("event_id") % 50 != 0, F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", metrics.level(F.element_at(names, (F.col("event_id") % 9 + 1).cast("int")), value).alias("level"))


@register("age_bands", "SELECT p_partkey, CASE WHEN p_size + 40 >= 18 AND p_size + 40 < 50 THEN '18-49' WHEN p_size + 40 < 70 THEN '50-69' WHEN p_size + 40 < 85 THEN '70-84' ELSE '85-199' END AS band FROM part")
def age_bands(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bands.age_band(F.col("p_size") + 40).alias("band"))


@register("top_rows_per_key", "SELECT o_custkey, o_orderkey, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_rows_per_key(spark, sf_dir):
    return ranking.top_k_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@register("cumulative_value", "SELECT o_orderkey, o_orderstatus, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey), 2) AS total FROM orders")
def cumulative_value(spark, sf_dir):
    rows = ranking.running_sum(table(spark, sf_dir, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderstatus"], ["o_totalprice"])
    return rows.select("o_orderkey", "o_orderstatus", F.round("cum_o_totalprice", 2).alias("total"))


@register("onset_counts", ONSETS + "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM f WHERE fires GROUP BY 1")
def onset_counts(spark, sf_dir):
    from tidemark.operators import timegrid

    high = table(spark, sf_dir, "events").where("value > 100").select("event_id", "user_id", "ts")
    return timegrid.suppressed(high, "user_id", "ts", 6, tie="event_id").groupBy("user_id").agg(F.count("*").alias("n"))
