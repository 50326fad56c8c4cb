"""Queries on sources, sinks, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.plans import records, signals
from tidemark.plans.catalogue import ORACLES, register
from tidemark.sources import ingest
from tidemark.sources.tables import table
from tidemark.session import shared_dir
from tidemark.streaming import streams

FIELDS = {"event_id": "bigint", "kind": "string", "value": "double"}


def _lines(spark, sf_dir):
    """Events as JSON lines, some of them broken, misfit or with a field too many."""
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), "value"))
    line = (
        F.when(F.col("event_id") % 50 == 1, F.concat(F.lit("{bad"), F.col("event_id").cast("string")))
        .when(F.col("event_id") % 50 == 2, F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"value":"much"}')))
        .when(F.col("event_id") % 50 == 3, F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"etco2":1}'))).otherwise(good)
    )
    return e.select("event_id", line.alias("line"))


@register(
    "rescued_lines",
    """
    SELECT event_id AS id, CASE WHEN event_id % 50 <> 1 THEN event_id END AS event_id, CASE WHEN event_id % 50 NOT IN (1, 2, 3) THEN event_type END AS kind,
           CASE WHEN event_id % 50 NOT IN (1, 2, 3) THEN value END AS value, event_id % 50 IN (1, 2, 3) AS rescued FROM events
    """,
)
def rescued_lines(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumnRenamed("event_id", "id")
    return ingest.parse_lines(rows, "line", FIELDS).withColumn("rescued", F.col("rescued").isNotNull())


@register("typed_projection", "SELECT event_id, CAST(NULL AS DOUBLE) AS etco2, CAST(value AS BIGINT) AS value FROM (SELECT event_id, trunc(value) AS value FROM events)")
def typed_projection(spark, sf_dir):
    return ingest.typed(table(spark, sf_dir, "events"), {"event_id": "bigint", "etco2": "double", "value": "bigint"})


@register("json_lines", "SELECT '{\"c_custkey\":' || c_custkey || CASE WHEN c_acctbal > 0 THEN ',\"segment\":\"' || c_mktsegment || '\"' ELSE '' END || '}' AS value FROM customer")
def json_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return ingest.json_lines(rows, ["c_custkey", "segment"])


@register("recent_rows", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 3 DAY AND ts <= TIMESTAMP '2024-01-15'")
def recent_rows(spark, sf_dir):
    return ingest.recent(table(spark, sf_dir, "events"), "ts", "2024-01-15", 3).select("event_id")


@register("snapshot_round_trip", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snapshot_round_trip(spark, sf_dir):
    """Two whole tables, published under the digest of their files, and fetched again."""
    root = shared_dir(spark, "snapshot")
    ingest.publish_snapshot(spark, {n: table(spark, sf_dir, n) for n in ("customer", "supplier")}, root, "1")
    found = ingest.fetch_snapshot(spark, root)
    parts = [found[n].select(F.col(f"{p}_{k}").alias("key"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance")) for n, p, k in (("customer", "c", "custkey"), ("supplier", "s", "suppkey"))]
    return parts[0].unionByName(parts[1])


def _landed(spark, sf_dir):
    """Events with copies of every tenth, as files of JSON lines."""
    folder = shared_dir(spark, "landing")
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props")
    events.unionByName(events.where("event_id % 10 = 0")).repartition(4, "event_id").write.json(folder)
    return folder


EVENT = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@register("stream_deduplicated", "SELECT event_id, user_id, value FROM events")
def stream_deduplicated(spark, sf_dir):
    landed, work = _landed(spark, sf_dir), shared_dir(spark, "stream")
    stream = streams.deduplicated(streams.json_stream(spark, landed, EVENT), ["event_id"], "ts")
    streams.drain(stream.select("event_id", "user_id", "value"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.schema("event_id BIGINT, user_id BIGINT, value DOUBLE").parquet(f"{work}/out")


@register("stream_quarantine", f"SELECT event_id, CAST(1 + CAST(event_id % 10 = 0 AS INT) AS BIGINT) AS copies FROM events WHERE NOT ({records.GOOD})")
def stream_quarantine(spark, sf_dir):
    landed, work = _landed(spark, sf_dir), shared_dir(spark, "stream")
    _, bad = streams.split(streams.json_stream(spark, landed, EVENT), records.RULES)
    streams.drain(bad.select("event_id", "failed_rules"), f"{work}/out", f"{work}/checkpoint")
    rows = spark.read.schema("event_id BIGINT, failed_rules ARRAY<STRING>").parquet(f"{work}/out")
    return rows.groupBy("event_id").agg(F.count("*").alias("copies"))


@register("stream_scd1", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_scd1(spark, sf_dir):
    landed, work = _landed(spark, sf_dir), shared_dir(spark, "stream")
    stream = streams.json_stream(spark, landed, EVENT, files_per_batch=2).select("user_id", "event_id", "ts", F.lit("U").alias("change_op"))
    streams.drain_scd1(stream, ["user_id"], ["ts", "event_id"], f"{work}/out", f"{work}/checkpoint")
    return streams.latest_state(spark, f"{work}/out").select("user_id", "event_id")


@register("stream_scd2", ORACLES["scd2_history"])
def stream_scd2(spark, sf_dir):
    """A change log that comes as files, a few in a batch, and the history that it makes."""
    landed, work = shared_dir(spark, "changes"), shared_dir(spark, "scd2")
    log = records.change_log(spark, sf_dir)
    log.repartition(4, "key").write.parquet(landed)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    versions = streams.drain_scd2(stream, ["key"], ["changed_at", "version"], ["status"], f"{work}/out", f"{work}/checkpoint")
    return versions.select("key", "status", "version", "start_at", "end_at")


@register(
    "time_split",
    """
    WITH s AS (SELECT date_trunc('day', min(ts)) AS s FROM events) SELECT event_id, CASE WHEN ts < s + INTERVAL 15 DAY - INTERVAL 6 HOUR THEN 'train'
    WHEN ts >= s + INTERVAL 15 DAY AND ts < s + INTERVAL 20 DAY - INTERVAL 6 HOUR THEN 'valid' WHEN ts >= s + INTERVAL 20 DAY THEN 'test' END AS part FROM events, s
    WHERE ts < s + INTERVAL 15 DAY - INTERVAL 6 HOUR OR (ts >= s + INTERVAL 15 DAY AND ts < s + INTERVAL 20 DAY - INTERVAL 6 HOUR) OR ts >= s + INTERVAL 20 DAY
    """,
)
def time_split(spark, sf_dir):
    return model.time_split(table(spark, sf_dir, "events"), "ts", 15, 5).select("event_id", "part")


@register("recent_split", "WITH e AS (SELECT max(ts) AS e FROM events) SELECT event_id, CASE WHEN ts > e - INTERVAL 3 DAY THEN 'test' WHEN ts > e - INTERVAL 8 DAY THEN 'valid' ELSE 'train' END AS part FROM events, e")
def recent_split(spark, sf_dir):
    return model.recent_split(table(spark, sf_dir, "events"), "ts", 5, 3).select("event_id", "part")


@register("one_hot_types", "SELECT event_id, CAST(event_type = 'view' AS INT)::DOUBLE AS is_view, CAST(event_type = 'click' AS INT)::DOUBLE AS is_click FROM events")
def one_hot_types(spark, sf_dir):
    rows = model.one_hot(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["view", "click"])
    return rows.select("event_id", F.col("event_type=view").alias("is_view"), F.col("event_type=click").alias("is_click"))


COEFFICIENTS = {"l_quantity": 0.8, "l_discount": -1.5, "l_tax": 0.4}
MEANS, SCALES = {"l_quantity": 25.0, "l_discount": 0.05, "l_tax": 0.04}, {"l_quantity": 14.0, "l_discount": 0.03, "l_tax": 0.02}


@register(
    "top_factors",
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, 0.8 * (l_quantity - 25) / 14 AS q, -1.5 * (l_discount - 0.05) / 0.03 + 0.4 * (l_tax - 0.04) / 0.02 AS m,
        abs(-1.5 * (l_discount - 0.05) / 0.03) >= abs(0.4 * (l_tax - 0.04) / 0.02) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN abs(q) > abs(m) THEN 'amount' ELSE 'money' END AS first_group, round(greatest(abs(q), abs(m)), 4) AS size FROM p WHERE abs(abs(q) - abs(m)) > 1e-6
    """,
)
def top_factors(spark, sf_dir):
    parts = model.contributions(COEFFICIENTS, MEANS, SCALES)
    factors = model.top_factors(parts, {"l_q": "amount", "l_": "money"}, 2)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.from_json(factors, "array<struct<group:string,driver:string,value:double>>").alias("f"))
    size = [F.abs(F.col("f")[i]["value"]) for i in range(2)]
    return rows.where(size[0] - size[1] > 1e-6).select("l_orderkey", "l_linenumber", F.col("f")[0]["group"].alias("first_group"), F.round(size[0], 4).alias("size"))


WHAT_IF = {"resp_rate": "l_quantity * 0.7", "spo2": "82 + l_linenumber * 2.5", "sbp": "80 + l_extendedprice / 400", "temp_c": "34.5 + l_discount * 50"}


@register(
    "what_if_vital",
    f"""
    SELECT l_orderkey, l_linenumber, 131.0 AS median_1h, round(q + (131 - q) / 3, 6) AS mean_3h, round(q + (131 - q) / 6, 6) AS mean_6h, round(-q + 131 - q, 6) AS trend_3h,
           CASE WHEN l_linestatus = 'O' THEN l_tax * 100 + 1 ELSE 2.0 END AS flow, resp_rate + spo2 + sbp + 3 + temp_c + 2 + 3 AS total FROM (
        SELECT *, l_quantity * 2.1 AS q, {signals._duck_band(f"round_even({WHAT_IF['resp_rate']}, 0)", 'resp_rate')} AS resp_rate, {signals._duck_band(f"round_even({WHAT_IF['spo2']}, 0)", 'spo2_scale_1')} AS spo2,
               {signals._duck_band(f"round_even({WHAT_IF['sbp']}, 0)", 'sbp')} AS sbp, {signals._duck_band(f"round_even({WHAT_IF['temp_c']}, 1)", 'temp_c')} AS temp_c FROM lineitem)
    """,
)
def what_if_vital(spark, sf_dir):
    """Another heart rate, oxygen put on, and confusion: the hour's figures, the means, and the score made again."""
    q = F.expr("l_quantity * 2.1")
    rate = {f"heart_rate_{s}": q for s in ("mean_1h", "median_1h", "min_1h", "max_1h", "mean_3h", "mean_6h")} | {"heart_rate_trend_3h": -q}
    medians = {f"{n}_median_1h": F.expr(sql) for n, sql in WHAT_IF.items()}
    flow = F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 100 + 1).otherwise(0.0)
    rows = table(spark, sf_dir, "lineitem").withColumns({**rate, **medians, "on_oxygen": F.col("l_linestatus") == "O", "o2_flow_lpm": flow, "acvpu": F.lit("A")})
    changed = model.what_if(rows, {"heart_rate": 131, "on_oxygen": True, "acvpu": "V"})
    return changed.select(
        "l_orderkey", "l_linenumber", F.col("heart_rate_median_1h").alias("median_1h"), *[F.round(f"heart_rate_{s}", 6).alias(s) for s in ("mean_3h", "mean_6h", "trend_3h")],
        F.col("o2_flow_lpm").alias("flow"), F.col("news2_total").alias("total"),
    )


@register("model_scores")
def model_scores(spark, sf_dir):
    """A linear model on the daily log, calibrated on its second part and applied to the third."""
    log = signals.score_log(spark, sf_dir)
    rows = model.time_split(log.withColumn("label", (F.col("score") > 1).cast("double")), "at", 15, 5)
    fitted = model.fit_linear(rows.where("part = 'train'"), ["risk", "unit"], "label")
    curve = model.fit_calibration(model.raw_scores(fitted, rows.where("part = 'valid'")), "label")
    return model.calibrated(curve, model.raw_scores(fitted, rows.where("part = 'test'"))).select("stay", "at", F.round("risk", 6).alias("risk"))


@register("unscored_rows", "SELECT user_id, ts FROM events WHERE (user_id, ts) NOT IN (SELECT (user_id, ts) FROM events WHERE event_id % 3 = 0)")
def unscored_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return model.unscored(events.select("user_id", "ts"), events.where("event_id % 3 = 0"), ["user_id", "ts"])
