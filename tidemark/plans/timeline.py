"""Queries of the time layer: interval, as-of and range joins, grids, runs, onsets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins, timegrid
from tidemark.plans.catalogue import register
from tidemark.sources.tables import table


def of_type(events, kind):
    """Events of one type."""
    return events.where(F.col("event_type") == kind)


def stays(events):
    """Intervals between a user's signups; the last is open."""
    signups = of_type(events, "signup").select("user_id", F.col("event_id").alias("stay_id"), F.col("ts").alias("start_ts"))
    return signups.withColumn("end_ts", F.lead("start_ts").over(Window.partitionBy("user_id").orderBy("start_ts", "stay_id")))


STAYS = """stays AS (
    SELECT user_id, event_id AS stay_id, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts
    FROM events WHERE event_type = 'signup')"""


@register(
    "hourly_buckets",
    """
    SELECT user_id, date_trunc('hour', ts) AS bucket, CAST(count(*) AS BIGINT) AS n_readings,
           round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median,
           min(value) AS value_min, max(value) AS value_max
    FROM events GROUP BY 1, 2
    """,
)
def hourly_buckets(spark, sf_dir):
    return timegrid.hourly_buckets(table(spark, sf_dir, "events"), "user_id", "ts", ["value"]).select(
        "user_id", "bucket", "n_readings", F.round("value_mean", 6).alias("value_mean"),
        F.round("value_median", 6).alias("value_median"), "value_min", "value_max",
    )


@register("data_window", "SELECT date_trunc('hour', min(ts)) AS data_start, date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS data_end FROM events")
def data_window(spark, sf_dir):
    return timegrid.data_window(table(spark, sf_dir, "events"), "ts")


LINKED = f"""
    WITH {STAYS}
    SELECT e.event_id, e.user_id, e.ts, e.value, s.stay_id FROM events e JOIN stays s
      ON e.user_id = s.user_id AND e.ts >= s.start_ts AND (s.end_ts IS NULL OR e.ts < s.end_ts)
"""


@register("interval_join", LINKED)
def interval_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return joins.interval_join(events, stays(events), "user_id", "ts", "start_ts", "end_ts").select("event_id", "user_id", "ts", "value", "stay_id")


@register("interval_join_binned", LINKED)
def interval_join_binned(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    linked = joins.interval_join(events, stays(events), "user_id", "ts", "start_ts", "end_ts", bin_seconds=30 * 86400)
    return linked.select("event_id", "user_id", "ts", "value", "stay_id")


@register(
    "prediction_grid",
    f"""
    WITH {STAYS}, w AS (SELECT TIMESTAMP '2024-01-20' AS as_of, (SELECT date_trunc('hour', min(ts)) FROM events) AS data_start),
    g AS (
        SELECT user_id, stay_id, date_trunc('hour', greatest(start_ts, data_start)) + INTERVAL 1 HOUR AS lo,
               least(coalesce(end_ts, as_of), as_of) AS hi FROM stays, w
    )
    SELECT user_id, stay_id, unnest(generate_series(lo, hi - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS prediction_ts FROM g WHERE lo < hi
    """,
)
def prediction_grid(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    start = events.agg(F.date_trunc("hour", F.min("ts")).alias("t")).first()["t"]
    grid = timegrid.prediction_grid(stays(events), "stay_id", "start_ts", "end_ts", datetime(2024, 1, 20), start)
    return grid.select("user_id", "stay_id", "prediction_ts")


def _asof(strict: bool) -> str:
    return f"""
    SELECT a.event_id, a.user_id, b.value AS last_value, b.event_id AS last_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b
      ON a.user_id = b.user_id AND a.ts {'>' if strict else '>='} b.ts
    """


def _last_click(spark, sf_dir, strict):
    events = table(spark, sf_dir, "events")
    clicks = of_type(events, "click").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    found = joins.asof_join(of_type(events, "purchase"), clicks, "user_id", "ts", "at", ["last_value", "last_id"], tie="last_id", strict=strict)
    return found.select("event_id", "user_id", "last_value", "last_id")


@register("asof_strict", _asof(True))
def asof_strict(spark, sf_dir):
    return _last_click(spark, sf_dir, True)


@register("asof_inclusive", _asof(False))
def asof_inclusive(spark, sf_dir):
    return _last_click(spark, sf_dir, False)


@register(
    "asof_with_fallback",
    """
    WITH a AS (SELECT * FROM events WHERE event_type = 'view'), b AS (SELECT * FROM events WHERE event_type = 'error')
    SELECT a.event_id, coalesce(
        (SELECT max_by(b.event_id, b.ts) FROM b WHERE b.user_id = a.user_id AND b.ts < a.ts),
        (SELECT min_by(b.event_id, b.ts) FROM b WHERE b.user_id = a.user_id)) AS unit FROM a
    """,
)
def asof_with_fallback(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = of_type(events, "error").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("unit"))
    views = of_type(events, "view")
    return joins.asof_join(views, errors, "user_id", "ts", "at", ["unit"], tie="unit", strict=True, fallback=True).select("event_id", "unit")


@register(
    "latest_observation",
    """
    WITH a AS (SELECT * FROM events WHERE event_type = 'purchase'), b AS (SELECT * FROM events WHERE event_type = 'view')
    SELECT a.event_id, coalesce(b.props, 'A') AS state, coalesce(b.value, 0.0) AS flow,
           round(epoch(a.ts - b.ts) / 3600, 6) AS hours_since
    FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts > b.ts
    """,
)
def latest_observation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seen = of_type(events, "view").select("user_id", F.col("ts").alias("obs_ts"), F.col("props").alias("state"), F.col("value").alias("flow"), F.col("event_id").alias("tie"))
    rows = joins.asof_join(of_type(events, "purchase"), seen, "user_id", "ts", "obs_ts", ["obs_ts", "state", "flow"], tie="tie", strict=True)
    hours = (joins.seconds("ts") - joins.seconds("obs_ts")) / 3600
    return rows.select("event_id", F.coalesce("state", F.lit("A")).alias("state"), F.coalesce("flow", F.lit(0.0)).alias("flow"), F.round(hours, 6).alias("hours_since"))


@register(
    "range_join_before",
    """
    WITH b AS (SELECT user_id, date_trunc('hour', ts) AS bucket, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2),
    g AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
    SELECT g.event_id, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_before, round(coalesce(sum(b.total), 0), 4) AS total_before
    FROM g LEFT JOIN b ON g.user_id = b.user_id AND b.bucket >= g.ts - INTERVAL 72 HOUR AND b.bucket < g.ts GROUP BY 1
    """,
)
def range_join_before(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hours = events.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    grid = of_type(events, "error").select("event_id", "user_id", "ts")
    rows = joins.range_before(grid, hours, "user_id", "ts", "bucket", 72)
    sums = rows.groupBy("event_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    return sums.select("event_id", "n_before", F.round("total", 4).alias("total_before"))


@register(
    "validity_join",
    """
    SELECT o.o_orderkey, CAST(count(l.l_linenumber) AS BIGINT) AS n_open FROM orders o
    LEFT JOIN (SELECT l_orderkey, l_linenumber, l_shipdate AS start_at, l_shipdate + INTERVAL 40 DAY AS stop_at FROM lineitem) l
      ON o.o_orderkey = l.l_orderkey AND l.start_at <= o.o_orderdate + INTERVAL 60 DAY AND l.stop_at > o.o_orderdate + INTERVAL 60 DAY
    GROUP BY 1
    """,
)
def validity_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("at"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_shipdate").alias("start_at"), (F.col("l_shipdate") + F.expr("INTERVAL 40 DAYS")).alias("stop_at"))
    return joins.valid_at(orders, lines, "o_orderkey", "at", "start_at", "stop_at").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n_open"))


@register(
    "shifted_self_join",
    """
    WITH b AS (SELECT user_id, date_trunc('day', ts) AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
    SELECT a.user_id, a.day, a.total, b.total AS day_before FROM b a LEFT JOIN b ON a.user_id = b.user_id AND a.day = b.day + INTERVAL 24 HOUR
    """,
)
def shifted_self_join(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    return joins.shifted(days, ["user_id"], "day", 24, "total", "day_before")


@register("first_outcome", "SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_outcome(spark, sf_dir):
    return joins.first_per_key(of_type(table(spark, sf_dir, "events"), "error"), "user_id", "ts", ["event_id", "value"], "event_id").select("user_id", "event_id", "ts", "value")


@register(
    "densified_hours",
    """
    WITH b AS (SELECT user_id, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM b GROUP BY 1)
    SELECT g.user_id, g.bucket, CAST(b.n AS BIGINT) AS n FROM g LEFT JOIN b USING (user_id, bucket)
    """,
)
def densified_hours(spark, sf_dir):
    buckets = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"))
    return timegrid.densify(buckets, "user_id", "bucket")


@register(
    "rolling_features",
    """
    WITH b AS (SELECT user_id, date_trunc('hour', ts) AS bucket, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2),
    w AS (
        SELECT *, sum(m * n) OVER t3 / sum(n) OVER t3 AS m3, sum(m * n) OVER t6 / sum(n) OVER t6 AS m6, sum(n) OVER t6 AS n6, max(m) OVER ago AS m_ago FROM b
        WINDOW t3 AS (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW),
               t6 AS (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW),
               ago AS (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND INTERVAL 2 HOUR PRECEDING)
    )
    SELECT user_id, bucket, round(m, 4) AS mean_1h, round(m3, 4) AS mean_3h, round(m6, 4) AS mean_6h, round(m - m_ago, 4) AS trend_3h,
           CAST(greatest(12 - n, 0) AS BIGINT) AS missing_1h, CAST(greatest(72 - n6, 0) AS BIGINT) AS missing_6h FROM w
    """,
)
def rolling_features(spark, sf_dir):
    buckets = timegrid.hourly_buckets(table(spark, sf_dir, "events"), "user_id", "ts", ["value"])
    rows = timegrid.rolling_features(buckets, "user_id", "bucket", "value")
    names = ("mean_1h", "mean_3h", "mean_6h", "trend_3h")
    return rows.select("user_id", "bucket", *[F.round(f"value_{n}", 4).alias(n) for n in names], "missing_1h", "missing_6h")


@register(
    "outage_gaps",
    """
    WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 600 MINUTE AS outage FROM events)
    SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE outage) AS BIGINT) AS outages FROM g GROUP BY 1
    """,
)
def outage_gaps(spark, sf_dir):
    rows = timegrid.gaps(table(spark, sf_dir, "events"), "user_id", "ts", 600)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("outage").alias("outages"))


@register(
    "stuck_runs",
    """
    WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c),
    l AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS size FROM r)
    SELECT user_id, date_trunc('day', ts) AS day, CAST(count(*) FILTER (WHERE size >= 3) * 5 AS BIGINT) AS stuck_minutes FROM l GROUP BY 1, 2
    """,
)
def stuck_runs(spark, sf_dir):
    rows = timegrid.equal_runs(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", 3)
    return rows.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg((F.count_if("stuck") * 5).alias("stuck_minutes"))


@register(
    "islands",
    """
    WITH i AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
    SELECT user_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(epoch(max(ts) - min(ts)) / 3600 + 1, 4) AS lead_hours
    FROM i GROUP BY 1, 2
    """,
)
def islands(spark, sf_dir):
    rows = timegrid.islands(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)
    hours = (joins.seconds(F.max("ts")) - joins.seconds(F.min("ts"))) / 3600 + 1
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(hours, 4).alias("lead_hours"))


ONSETS = """
    WITH RECURSIVE h AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE value > 100),
    f AS (
        SELECT event_id, user_id, ts, rn, ts AS fired_at, true AS fires FROM h WHERE rn = 1
        UNION ALL
        SELECT h.event_id, h.user_id, h.ts, h.rn, CASE WHEN h.ts - f.fired_at >= INTERVAL 6 HOUR THEN h.ts ELSE f.fired_at END, h.ts - f.fired_at >= INTERVAL 6 HOUR
        FROM f JOIN h ON h.user_id = f.user_id AND h.rn = f.rn + 1
    )
"""


@register("suppressed_onsets", ONSETS + "SELECT event_id, user_id, ts FROM f WHERE fires")
def suppressed_onsets(spark, sf_dir):
    high = table(spark, sf_dir, "events").where("value > 100").select("event_id", "user_id", "ts")
    return timegrid.suppressed(high, "user_id", "ts", 6, tie="event_id")


@register(
    "high_entries",
    """
    WITH b AS (SELECT user_id, date_trunc('day', ts) AS day, max(value) > 60 AS high FROM events GROUP BY 1, 2),
    l AS (SELECT *, lag(high) OVER w AS high_before, lag(day) OVER w AS day_before FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, day FROM l WHERE high AND NOT coalesce(high_before AND day - day_before = INTERVAL 1 DAY, false)
    """,
)
def high_entries(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg((F.max("value") > 60).alias("high"))
    return timegrid.entries(days, "user_id", "day", "high", 86400).select("user_id", "day")


@register(
    "expected_messages",
    f"""
    WITH {STAYS}, c AS (SELECT user_id, start_ts, coalesce(end_ts, TIMESTAMP '2024-02-01') AS end_ts FROM stays),
    d AS (
        SELECT user_id, start_ts, end_ts, unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS day
        FROM c WHERE end_ts > start_ts
    )
    SELECT user_id, day, CAST(round_even(round(sum(epoch(least(end_ts, day + INTERVAL 1 DAY)) - epoch(greatest(start_ts, day))) / 300, 6), 0) AS BIGINT) AS expected FROM d GROUP BY 1, 2
    """,
)
def expected_messages(spark, sf_dir):
    closed = stays(table(spark, sf_dir, "events")).withColumn("end_ts", F.coalesce("end_ts", F.lit("2024-02-01").cast("timestamp_ntz")))
    rows = timegrid.split_by_day(closed, "start_ts", "end_ts")
    return rows.groupBy("user_id", "day").agg(F.bround(F.round(F.sum("minutes") / 5, 6), 0).cast("long").alias("expected"))
