"""Queries on drift checks, resampling, data quality and the guards around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import metrics, ranking, sqlguard
from tidemark.operators import alerts, history, monitoring, quality
from tidemark.plans import signals
from tidemark.plans.catalogue import register
from tidemark.sources import ingest
from tidemark.sources.tables import table

DAY = signals.DAY
FEATURES = ("l_quantity", "l_extendedprice")


def level_sql(name: str, value: str = "value") -> str:
    """CASE for a signal's level."""
    warn, act = metrics.LIMITS[name]
    acts = "" if act == float("inf") else f"WHEN {value} >= {act} THEN 'act' "
    return f"CASE WHEN {value} IS NULL THEN 'not enough data' {acts}WHEN {value} >= {warn} THEN 'warn' ELSE 'stable' END"


def rounded(rows):
    """Signals with their numbers to 5 places."""
    return rows.select("signal", "feature", "site", *[F.round(c, 5).alias(c) for c in ("value", "observed", "reference")], "n", "level")


DRIFT = f"""
    WITH l AS (SELECT l_returnflag AS site, l_shipdate < TIMESTAMP '1998-01-01' AS old, l_quantity, l_extendedprice * CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 1.1 END AS l_extendedprice FROM lineitem),
    s AS (SELECT *, unnest(['all', site]) AS slice FROM l),
    x AS ({' UNION ALL '.join(f"SELECT old, slice, '{f}' AS feature, {f} AS v FROM s" for f in FEATURES)}),
    e AS (SELECT slice, feature, list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM x WHERE old GROUP BY ALL),
    c AS (SELECT slice, feature, old, len(list_filter(q, lambda edge: edge <= v)) AS k, count(*) AS n FROM x JOIN e USING (slice, feature) GROUP BY ALL),
    b AS (SELECT slice, feature, unnest(range(0, len(q) + 1)) AS k FROM e),
    t AS (SELECT b.slice, b.feature, b.k, coalesce(max(n) FILTER (WHERE old), 0) AS a, coalesce(max(n) FILTER (WHERE NOT old), 0) AS c FROM b LEFT JOIN c USING (slice, feature, k) GROUP BY ALL),
    u AS (SELECT *, sum(a) OVER w AS na, sum(c) OVER w AS nc FROM t WINDOW w AS (PARTITION BY slice, feature)),
    p AS (SELECT *, greatest(a / na, 1e-4) AS pa, greatest(c / nc, 1e-4) AS pc FROM u WHERE nc > 0),
    f AS (SELECT *, pa / sum(pa) OVER w AS fa, pc / sum(pc) OVER w AS fc FROM p WINDOW w AS (PARTITION BY slice, feature)),
    r AS (SELECT feature, slice AS site, CASE WHEN max(na) >= 500 AND max(nc) >= 500 THEN sum((fc - fa) * ln(fc / fa)) END AS value, CAST(max(nc) AS BIGINT) AS n FROM f GROUP BY ALL)
    SELECT 'feature_psi' AS signal, feature, site, round(value, 5) AS value, round(value, 5) AS observed, CAST(NULL AS DOUBLE) AS reference, n, {level_sql('feature_psi')} AS level FROM r
"""


def input_drift(spark, sf_dir):
    edge = F.lit("1998-01-01").cast("timestamp_ntz")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("site"), "l_shipdate", *FEATURES)
    now = lines.where(F.col("l_shipdate") >= edge).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.1)
    return monitoring.input_drift(lines.where(F.col("l_shipdate") < edge), now, FEATURES)


@register("drift_by_slice", DRIFT)
def drift_by_slice(spark, sf_dir):
    return rounded(input_drift(spark, sf_dir))


LOAD = f"""
    WITH RECURSIVE {signals.LOG}, o AS (SELECT unnest(['all', CAST(site AS VARCHAR)]) AS site, count(*) AS alerts FROM onsets WHERE day_at >= TIMESTAMP '2024-01-10' GROUP BY 1),
    l AS (SELECT unnest(['all', CAST(site AS VARCHAR)]) AS site, count(*) AS n FROM log WHERE day_at >= TIMESTAMP '2024-01-10' GROUP BY 1),
    r AS (SELECT site, n, CASE WHEN n >= 500 THEN coalesce(alerts, 0) * 60.0 / n END AS value FROM l LEFT JOIN o USING (site))
    SELECT 'alerts_per_nurse_shift' AS signal, CAST(NULL AS VARCHAR) AS feature, site, round(value, 5) AS value, round(value, 5) AS observed, CAST(NULL AS DOUBLE) AS reference, CAST(n AS BIGINT) AS n,
           {level_sql('alerts_per_nurse_shift')} AS level FROM r
"""


def alert_load(spark, sf_dir):
    return monitoring.alert_load(signals.score_log(spark, sf_dir), "2024-01-10", DAY, 72)


@register("alert_load_by_slice", LOAD)
def alert_load_by_slice(spark, sf_dir):
    return rounded(alert_load(spark, sf_dir))


def weights_sql(stay: str, replicates: int) -> str:
    """SELECT of stay, replicate, weight from a table `stays`: the hashed Poisson weights."""
    total, term, cases = 0.0, metrics.POISSON, []
    for k in range(1, 9):
        total += term
        cases.append(f"CASE WHEN u >= {total!r} THEN 1 ELSE 0 END")
        term /= k
    return f"""SELECT stay, replicate, {' + '.join(cases)} AS weight FROM (
        SELECT {stay} AS stay, replicate, CAST('0x' || substr(md5({stay} || ':' || replicate || ':1'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM stays, range(1, {replicates + 1}) t(replicate))"""


PERFORMANCE = f"""
    WITH {signals.LABELLED}, stays AS (SELECT DISTINCT doc_id % 40 AS stay FROM d), w AS ({weights_sql('stay', 20)}),
    j AS (SELECT replicate, score, quality, weight FROM d JOIN w ON d.doc_id % 40 = w.stay WHERE weight > 0),
    s AS (SELECT replicate, score, sum(weight * quality) AS pos, sum(weight * (1 - quality)) AS neg, sum(weight * power(score - quality, 2)) AS err FROM j GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER w2 AS tp, sum(neg) OVER w2 AS fp FROM s WINDOW w2 AS (PARTITION BY replicate ORDER BY score DESC)),
    m AS (SELECT replicate, sum(pos * tp / (tp + fp)) / sum(pos) AS auprc, sum(err) / sum(pos + neg) AS brier FROM c GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0),
    ends AS (SELECT quantile_cont(auprc, 0.95) AS most, quantile_cont(brier, 0.05) AS least FROM m),
    one AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM d GROUP BY 1), cum AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM one WINDOW o AS (ORDER BY score DESC)),
    point AS (SELECT (SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM cum) AS auprc, (SELECT avg(power(score - quality, 2)) FROM d) AS brier, (SELECT sum(quality) FROM d) AS n),
    r AS (
        SELECT 'auprc_drop' AS signal, greatest(1 - most / 0.99, 0) AS value, auprc AS observed, 0.99 AS reference, n FROM ends, point
        UNION ALL SELECT 'brier_rise', greatest(least / 0.2 - 1, 0), brier, 0.2, n FROM ends, point
    )
    SELECT signal, CAST(NULL AS VARCHAR) AS feature, 'all' AS site, round(CASE WHEN n >= 10 THEN value END, 5) AS value, round(CASE WHEN n >= 10 THEN observed END, 5) AS observed, CAST(reference AS DOUBLE) AS reference, CAST(n AS BIGINT) AS n,
           CASE WHEN n < 10 THEN 'not enough data' WHEN value >= 0.2 THEN 'act' WHEN value >= 0.1 THEN 'warn' ELSE 'stable' END AS level FROM r
"""


@register("performance_drift", PERFORMANCE)
def performance_drift(spark, sf_dir):
    """Labelled documents as hours of 40 stays, so that each good one is a run of its own."""
    rows = signals.labelled(spark, sf_dir).select(
        (F.col("doc_id") % 40).alias("stay"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("at"), F.col("score").alias("risk"), F.col("quality").alias("label")
    )
    return rounded(monitoring.performance(rows, {"auprc": 0.99, "brier": 0.2}, 3600, 20))


QUALITY = f"""
    WITH e AS (SELECT ts, event_id, CASE WHEN event_type <> 'click' OR ts < TIMESTAMP '2024-01-12' THEN value END AS value, CASE WHEN value <= 90 THEN props END AS props FROM events),
    r AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-10' AND NOT (ts >= TIMESTAMP '2024-01-03' - INTERVAL 1 HOUR AND ts < TIMESTAMP '2024-01-04')),
    c AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-10'), q AS (SELECT count(*) AS held FROM c WHERE event_id % 30 = 0),
    a AS (SELECT (SELECT count(*) FROM c) AS n, held, (SELECT avg((value IS NULL)::INT) FROM r) AS v_then, (SELECT avg((value IS NULL)::INT) FROM c) AS v_now,
          (SELECT avg((props IS NULL)::INT) FROM r) AS p_then, (SELECT avg((props IS NULL)::INT) FROM c) AS p_now FROM q),
    s AS (
        SELECT 'quarantine_rate' AS signal, CAST(NULL AS VARCHAR) AS feature, held / (n + held) AS value, held / (n + held) AS observed, CAST(NULL AS DOUBLE) AS reference, n + held AS n, n + held >= 500 AS enough FROM a
        UNION ALL SELECT 'missing_rate_change', 'value', abs(v_now - v_then), v_now, v_then, n, n + held >= 500 FROM a
        UNION ALL SELECT 'missing_rate_change', 'props', abs(p_now - p_then), p_now, p_then, n, n + held >= 500 FROM a
    )
    SELECT signal, feature, 'all' AS site, round(CASE WHEN enough THEN value END, 5) AS value, round(CASE WHEN enough THEN observed END, 5) AS observed, round(reference, 5) AS reference, CAST(n AS BIGINT) AS n,
           CASE WHEN NOT enough THEN 'not enough data' WHEN value >= 0.05 THEN 'act' WHEN value >= 0.02 THEN 'warn' ELSE 'stable' END AS level FROM s
"""


def data_quality(spark, sf_dir):
    edge = lambda t: F.lit(t).cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").select(
        "ts", "event_id", F.when((F.col("event_type") != "click") | (F.col("ts") < edge("2024-01-12")), F.col("value")).alias("value"), F.when(F.col("value") <= 90, F.col("props")).alias("props")
    )
    reference = monitoring.without_faults(events.where(F.col("ts") < edge("2024-01-10")), [("2024-01-03", "2024-01-04")], "ts")
    current = events.where(F.col("ts") >= edge("2024-01-10"))
    return monitoring.data_quality(reference, current, current.where("event_id % 30 = 0"), ["value", "props"])


@register("quality_signals", QUALITY)
def quality_signals(spark, sf_dir):
    return rounded(data_quality(spark, sf_dir))


CHECK = f"SELECT * FROM ({DRIFT}) UNION ALL SELECT * FROM ({LOAD}) UNION ALL SELECT * FROM ({QUALITY})"


@register(
    "check_summary",
    f"""
    WITH s AS ({CHECK}), b AS (
        SELECT *, CASE level WHEN 'act' THEN 0 ELSE 1 END AS rank, signal || CASE WHEN feature IS NULL THEN '' ELSE ' (' || feature || ')' END || CASE WHEN site = 'all' THEN '' ELSE ' at ' || site END || ': ' || level AS text,
            CASE signal WHEN 'feature_psi' THEN 'inputs' WHEN 'alerts_per_nurse_shift' THEN 'alert-load' ELSE 'data-quality' END || CASE WHEN site = 'all' THEN '' ELSE '@' || site END AS kind FROM s WHERE level IN ('warn', 'act')
    )
    SELECT CASE WHEN count(*) FILTER (WHERE level = 'act') > 0 THEN 'act' WHEN count(*) > 0 THEN 'warn' ELSE 'stable' END AS status, CAST(count(*) FILTER (WHERE level = 'warn') AS BIGINT) AS n_warn,
           CAST(count(*) FILTER (WHERE level = 'act') AS BIGINT) AS n_act, coalesce(string_agg(text, '; ' ORDER BY rank, value DESC, text), '') AS breaches,
           coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE level = 'act'), '') AS kinds FROM b
    """,
)
def check_summary(spark, sf_dir):
    every = input_drift(spark, sf_dir).unionByName(alert_load(spark, sf_dir)).unionByName(data_quality(spark, sf_dir))
    row = monitoring.summary(every)
    return row.withColumns({"breaches": F.array_join("breaches", "; "), "kinds": F.array_join("kinds", ",")})


MONITOR = """
    p AS (
        SELECT ts, value, unnest(['*', CAST(user_id % 2 AS VARCHAR)]) AS model_version, user_id FROM events
    ), s AS (SELECT *, unnest(['all', CAST(user_id % 3 AS VARCHAR)]) AS site FROM p),
    g AS (
        SELECT 'd' AS g, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, model_version, site, count(*) AS n, avg(value) AS v, min(value) AS least FROM s GROUP BY ALL
        UNION ALL SELECT 'w', date_trunc('week', ts), date_trunc('week', ts) + INTERVAL 7 DAY, model_version, site, count(*), avg(value), min(value) FROM s GROUP BY ALL
    ), day AS (SELECT * FROM g WHERE g = 'd' AND window_end <= TIMESTAMP '2024-01-16' QUALIFY window_end = max(window_end) OVER ()),
    week AS (SELECT * FROM g WHERE g = 'w' AND window_end <= TIMESTAMP '2024-01-16' QUALIFY window_end = max(window_end) OVER ()),
    best AS (SELECT model_version FROM day WHERE model_version <> '*' AND site = 'all' ORDER BY n DESC, model_version DESC LIMIT 1),
    js AS (SELECT * FROM g WHERE g = 'd' AND model_version = (SELECT model_version FROM best) AND window_end <= TIMESTAMP '2024-01-16' QUALIFY window_end = max(window_end) OVER ()),
    monitor AS (
        SELECT 'lm_alerts_per_nurse_shift' AS signal, CAST(NULL AS VARCHAR) AS feature, site, v / 10 AS value, n FROM day WHERE model_version = '*'
        UNION ALL SELECT 'lm_prediction_js', 'v' || js.model_version, js.site, js.v / 1000, coalesce(d.n, 0) FROM js LEFT JOIN day d ON d.model_version = js.model_version AND d.site = js.site
        UNION ALL SELECT 'lm_auprc_week', NULL, site, v / 200, n FROM week WHERE model_version = '*'
        UNION ALL SELECT 'lm_brier_week', NULL, site, least / 1000, n FROM week WHERE model_version = '*'
        UNION ALL SELECT 'lm_auroc_week', NULL, site, v / 100, n FROM week WHERE model_version = '*'
    )"""


def monitor_rows(spark, sf_dir):
    """A monitor's two output tables, made of events by day and week, for all versions and each, in all and at each site."""
    each = lambda first, name: F.explode(F.array(F.lit(first), (F.col("user_id") % name).cast("string")))
    rows = table(spark, sf_dir, "events").withColumn("model_version", each("*", 2)).withColumn("slice_value", each(None, 3))
    rows = rows.withColumn("slice_key", F.when(F.col("slice_value").isNotNull(), "site_id"))
    out = None
    for granularity, unit, width in (("1 day", "day", 1), ("1 week", "week", 7)):
        start = F.date_trunc(unit, "ts").alias("window_start")
        part = rows.groupBy(start, "model_version", "slice_key", "slice_value").agg(
            F.count("*").alias("count"), (F.avg("value") / 10).alias("alerts_per_nurse_shift"), (F.avg("value") / 200).alias("auprc"), (F.min("value") / 1000).alias("brier"),
            (F.avg("value") / 100).alias("auroc"), (F.avg("value") / 1000).alias("js_distance"),
        )
        part = part.withColumn("granularity", F.lit(granularity)).withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {width} DAYS"))
        out = part if out is None else out.unionByName(part)
    return out


@register("monitor_signals", f"WITH {MONITOR} SELECT signal, feature, site, round(value, 6) AS value, CAST(n AS BIGINT) AS n, 'shadow' AS level FROM monitor")
def monitor_signals(spark, sf_dir):
    both = monitor_rows(spark, sf_dir)
    return monitoring.monitor_signals(both, both, "2024-01-16").select("signal", "feature", "site", F.round("value", 6).alias("value"), "n", "level")


@register(
    "monitor_agreement",
    f"""
    WITH o AS ({LOAD}), r AS (SELECT site, n, value AS ours, value * CASE WHEN site = 'all' THEN 1.02 ELSE 1.001 END AS theirs FROM o WHERE value IS NOT NULL)
    SELECT 'monitor_difference' AS signal, 'alerts_per_nurse_shift' AS feature, site, round(abs(theirs - ours) / greatest(abs(ours), 1e-9), 5) AS value, n,
           CASE WHEN abs(theirs - ours) / greatest(abs(ours), 1e-9) >= 0.01 THEN 'warn' ELSE 'stable' END AS level FROM r
    """,
)
def monitor_agreement(spark, sf_dir):
    ours = alert_load(spark, sf_dir)
    theirs = ours.withColumn("signal", F.concat(F.lit("lm_"), "signal")).withColumn("value", F.col("value") * F.when(F.col("site") == "all", 1.02).otherwise(1.001))
    return monitoring.cross_check(ours, theirs, "1").select("signal", "feature", "site", F.round("value", 5).alias("value"), "n", "level")


@register(
    "reference_labels",
    f"""
    WITH RECURSIVE {signals.LOG}, now AS (SELECT TIMESTAMP '2024-01-25' AS t)
    SELECT l.stay, l.day_at, CASE WHEN count(o.event_at) > 0 THEN 1 WHEN l.day_at + INTERVAL 72 HOUR <= max(t) THEN 0 END AS label, l.day_at + INTERVAL 72 HOUR AS known_at
    FROM log l CROSS JOIN now LEFT JOIN outcomes o ON o.stay = l.stay AND o.event_at <= t AND o.event_at > l.day_at AND o.event_at <= l.day_at + INTERVAL 72 HOUR GROUP BY 1, 2
    """,
)
def reference_labels(spark, sf_dir):
    rows = alerts.reference_labels(signals.score_log(spark, sf_dir), signals.outcomes(spark, sf_dir), signals.KNOWN, 72)
    return rows.withColumnRenamed("at", "day_at")


@register(
    "budget_threshold",
    f"WITH RECURSIVE {signals.LOG}, c AS (SELECT DISTINCT unnest(quantile_cont(risk, [{', '.join(repr(0.5 + 0.4999 * i / 9) for i in range(10))}])) AS threshold FROM log) SELECT round(threshold, 6) AS threshold FROM c",
)
def candidate_thresholds(spark, sf_dir):
    """The thresholds that a search for a budget tries; a test runs the search itself."""
    found = alerts.candidate_thresholds(signals.score_log(spark, sf_dir), "risk", 10)
    return spark.createDataFrame([(round(x, 6),) for x in found], "threshold double")


@register("stay_numbers", "WITH f AS (SELECT user_id, min(ts) AS first_at FROM events GROUP BY 1) SELECT user_id, 'P-' || (1000 + row_number() OVER (ORDER BY first_at, user_id)) AS name FROM f")
def stay_numbers(spark, sf_dir):
    """Names by first appearance, without a window over the whole table."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"))
    return ranking.dense_number(first, ["first_at", "user_id"], "n").select("user_id", F.concat(F.lit("P-"), (F.col("n") + 1000).cast("string")).alias("name"))


@register("numbered_rows", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events")
def numbered_rows(spark, sf_dir):
    return ranking.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "place").select("event_id", "place")


@register("change_set", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'I' ELSE 'U' END AS change_op FROM customer WHERE c_custkey % 5 = 0 OR (c_custkey % 7 = 0 AND c_acctbal IS NOT NULL)")
def change_set(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    old = new.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return history.change_set(old, new, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "change_op")


@register("missing_columns", "SELECT 'etco2' AS name UNION ALL SELECT 'firmware'")
def missing_columns(spark, sf_dir):
    found = ingest.missing_columns(table(spark, sf_dir, "events"), ["firmware", "event_id", "ts", "etco2"])
    return spark.createDataFrame([(n,) for n in found], "name string")


@register("widened_rows", "SELECT event_id, CAST(NULL AS DOUBLE) AS etco2 FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 2 = 1")
def widened_rows(spark, sf_dir):
    """Older rows take the columns that newer ones brought."""
    events = table(spark, sf_dir, "events")
    new = events.where("event_id % 2 = 1").select("event_id", F.col("value").alias("etco2"))
    return ingest.widened(events.where("event_id % 2 = 0").select("event_id"), {"event_id": "bigint", "etco2": "double"}).unionByName(new)


@register("lineage", "SELECT event_id, 'events.parquet' AS file, true AS dated FROM events")
def lineage(spark, sf_dir):
    rows = ingest.with_lineage(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.select("event_id", F.element_at(F.split("_source_file", "/"), -1).alias("file"), F.col("_ingest_ts").isNotNull().alias("dated"))


@register("exported_entities", "SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 3 DAY AND ts <= TIMESTAMP '2024-01-15')")
def exported_entities(spark, sf_dir):
    """What an export of three days takes along, after it made sure that all of it is scored."""
    events = table(spark, sf_dir, "events")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return ingest.export_window(events, people, events, "user_id", "ts", "2024-01-15", 3)[1]


@register("guarded_answer", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def guarded_answer(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("guarded_events")
    text = "WITH e AS (SELECT * FROM guarded_events) SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM e GROUP BY event_type;"
    return spark.createDataFrame(sqlguard.answer(spark, text, {"guarded_events"}, seconds=120), "event_type string, n long, mean double")


@register("fresh_days", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1")
def fresh_days(spark, sf_dir):
    """Daily counts, once it is sure that they are not older than what they are made from."""
    events = table(spark, sf_dir, "events")
    days = events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    quality.require_current(events, days, "ts")
    return days.select("day", "n")
