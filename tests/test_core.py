from __future__ import annotations

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import bands, metrics, model, ranking, retrieval, sqlguard
from tidemark.operators import alerts, history, joins, monitoring, quality, timegrid
from tidemark.plans import catalogue, named  # noqa: F401, the catalogue loads the others in order
from tidemark.sources import ingest, registry
from tidemark.streaming import streams

T0 = datetime(2024, 1, 1)


def hours(*hs):
    return [T0 + timedelta(hours=h) for h in hs]


def test_interval_join_edges_and_bins(spark):
    points = spark.createDataFrame([("a", t, i) for i, t in enumerate(hours(0, 1, 2, 10, 50))], "key string, ts timestamp, i int")
    spans = spark.createDataFrame([("a", T0, T0 + timedelta(hours=2), "x"), ("a", T0 + timedelta(hours=10), None, "y")], "key string, lo timestamp, hi timestamp, name string")
    want = {(0, "x"), (1, "x"), (3, "y"), (4, "y")}
    for bin_seconds in (None, 3600, 7200):
        got = joins.interval_join(points, spans, "key", "ts", "lo", "hi", bin_seconds=bin_seconds).select("i", "name").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_asof_strict_and_ties(spark):
    left = spark.createDataFrame([("a", T0 + timedelta(hours=1))], "key string, ts timestamp")
    right = spark.createDataFrame([("a", T0, 1), ("a", T0 + timedelta(hours=1), 2), ("a", T0 + timedelta(hours=1), 3)], "key string, at timestamp, v int")
    assert joins.asof_join(left, right, "key", "ts", "at", ["v"], tie="v").first().v == 3
    assert joins.asof_join(left, right, "key", "ts", "at", ["v"], tie="v", strict=True).first().v == 1


def test_asof_nulls_and_fallback(spark):
    left = spark.createDataFrame([("a", T0, 0), (None, T0, 1), ("a", None, 2), ("b", T0, 3)], "key string, ts timestamp, i int")
    right = spark.createDataFrame([("a", None, 7), (None, T0, 9), ("a", T0 + timedelta(hours=1), 5)], "key string, at timestamp, v int")
    for strict, fallback, want in ((False, False, [None] * 4), (True, True, [5, None, None, None])):
        got = joins.asof_join(left, right, "key", "ts", "at", ["v"], strict=strict, fallback=fallback).orderBy("i").collect()
        assert [r.v for r in got] == want and [r.i for r in got] == [0, 1, 2, 3]


def test_numbers_over_many_rows_with_more_columns(spark):
    """Ranks, running sums and what is made of them, where ranges are sampled: columns beyond the order's change nothing."""
    n = 1_500_000
    rows = spark.range(n).select("id", F.expr("id % 2").alias("g"), (F.rand(3) * 1000).alias("s"), F.expr("cast(pmod(hash(id), 7) = 0 as int)").alias("y"), F.repeat(F.lit("pad"), 5).alias("more"))
    rows = rows.withColumn("s", F.round("s", 1))
    top = ranking.running_sum(rows.withColumn("one", F.lit(1)), [F.col("s"), F.col("id")], ["g"], ["one"]).groupBy("g").agg(F.max("cum_one").alias("m"), F.countDistinct("cum_one").alias("d")).collect()
    assert [(r.m, r.d) for r in top] == [(n // 2, n // 2)] * 2
    placed = ranking.dense_number(rows, [F.desc("s"), F.col("id")], "place")
    assert placed.agg(F.max("place"), F.countDistinct("place")).first() == (n, n)
    assert [r.n for r in metrics.calibration(rows, "s", "y", "id").orderBy("bin").collect()] == [n // 10] * 10
    quantiles = metrics.quantiles(rows, "s", [0.0, 0.1, 0.5, 1.0], ["g"]).join(rows.groupBy("g").agg(F.percentile("s", F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 1.0)])).alias("p")), "g").collect()
    assert all(r.quantiles == pytest.approx(r.p) for r in quantiles)
    sample = rows.where("id % 50 = 0").toPandas()
    got = metrics.ranking_quality(rows.where("id % 50 = 0"), "s", "y").first().auroc
    rank = sample["s"].rank()
    positives = int(sample["y"].sum())
    assert got == pytest.approx((rank[sample["y"] == 1].sum() - positives * (positives + 1) / 2) / (positives * (len(sample) - positives)))


def test_budget_search(spark):
    log = spark.createDataFrame([(s, T0 + timedelta(hours=h), 0.1 * ((s * 7 + h * 3) % 10)) for s in range(6) for h in range(24)], "stay int, at timestamp, risk double")
    candidates = alerts.candidate_thresholds(log, grid=8)

    def count(threshold):
        fired, total = {}, 0
        for s in range(6):
            before = False
            for h in range(24):
                high = 0.1 * ((s * 7 + h * 3) % 10) >= threshold
                if high and not before and (s not in fired or h - fired[s] >= 6):
                    fired[s], total = h, total + 1
                before = high
        return total

    want = max(candidates)
    for c in candidates:
        if count(c) > 0.08 * 144:
            break
        want = c
    assert alerts.budget_threshold(log, candidates, 0.08, 3600, 6) == want


def test_vanished_rows_and_publishing(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "c"), (3, "d")], "k int, v string")
    with pytest.raises(ValueError, match="vanished"):
        history.change_set(old, new, ["k"], ["v"])
    assert {(r.k, r.change_op) for r in history.change_set(old.where("k = 1"), new, ["k"], ["v"]).collect()} == {(1, "U"), (3, "I")}
    root = f"file://{tmp_path}/published"
    first, second = (ingest.publish_snapshot(spark, {"t": f}, root, v) for f, v in ((old, "1"), (new, "2")))
    assert first != second and {r.k for r in ingest.fetch_snapshot(spark, root)["t"].collect()} == {1, 3}
    spark.range(3).write.mode("append").parquet(f"{root}/{json.loads(second)['sha256'][:16]}/t")
    with pytest.raises(ValueError, match="not those"):
        ingest.fetch_snapshot(spark, root)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_answers_are_kept_and_fall_back(spark):
    snapshot = named.Facts(spark, "/root/testdata/sf0.001")
    live = named.Facts(spark, "/root/testdata/sf0.001", keep=1, snapshot=snapshot)
    units = live.rows(named.UNITS, as_of="2024-01-15", site=None)
    assert units and live.rows(named.UNITS, as_of="2024-01-15", site=None) is units and not live.stale
    live.rows(named.NOW)
    assert len(live.answers) == 1 and live.rows(named.UNITS, as_of="2024-01-15", site=None) == units
    live.frames["log"] = live.frames["kpis"] = spark.sql("SELECT raise_error('asleep') AS day_at, 1L AS site, 1L AS unit, 1L AS census, 1L AS n_low, 1L AS n_high, 1.0D AS mean_score")
    live.max_age = -1.0
    assert live.rows(named.UNITS, as_of="2024-01-15", site=None) == units and live.stale
    assert live.rows(named.UNITS, as_of="2030-01-01", site=None) == snapshot.rows(named.UNITS, as_of=str(snapshot.rows(named.NOW)[0].last_at), site=None)


def test_monitor_behind(spark):
    day = spark.createDataFrame([("1 day", T0, T0 + timedelta(days=1), "*", None, None, 5, 1.0, 0.1, 0.1, 0.5)], "granularity string, window_start timestamp, window_end timestamp, model_version string, slice_key string, slice_value string, count long, alerts_per_nurse_shift double, auprc double, brier double, auroc double")
    drift = day.withColumn("js_distance", F.lit(0.0))
    assert monitoring.monitor_signals(day, drift, "2024-01-02").count() == 1
    with pytest.raises(monitoring.MonitorBehind):
        monitoring.monitor_signals(day, drift, "2024-01-03")


def test_scd1_keeps_untouched_parts(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    ddl = "k BIGINT, t BIGINT, change_op STRING"
    for t, keys in ((1, range(40)), (2, range(5)), (3, range(3))):
        spark.createDataFrame([(k, t, "U") for k in keys], ddl).coalesce(1).write.mode("append").json(landing)
        streams.drain_scd1(streams.json_stream(spark, landing, ddl).select("k", "t", "change_op"), ["k"], ["t"], out, mark)
        spark.read.schema(ddl).json(landing)
    assert {r.k: r.t for r in streams.latest_state(spark, out).collect()} == {k: 3 if k < 3 else 2 if k < 5 else 1 for k in range(40)}
    listed = streams._listed(spark, out)
    assert len(listed) < 3 * streams.BUCKETS and {b for _, b in listed} == {0, 1, 2}


def test_suppression_is_greedy(spark):
    rows = spark.createDataFrame([("a", t) for t in hours(0, 4, 7, 9, 13)], "key string, ts timestamp")
    fired = timegrid.suppressed(rows, "key", "ts", 6).orderBy("ts").collect()
    assert [r.ts for r in fired] == hours(0, 7, 13)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=25, unique=True))
def test_suppression_equals_fold(spark, hs):
    want, last = [], None
    for h in sorted(hs):
        if last is None or h - last >= 6:
            want.append(h)
            last = h
    rows = spark.createDataFrame([("a", t) for t in hours(*hs)], "key string, ts timestamp")
    got = timegrid.suppressed(rows, "key", "ts", 6).orderBy("ts").collect()
    assert [r.ts for r in got] == hours(*want)


def test_scd2_ignores_repeats_and_untracked(spark):
    log = spark.createDataFrame([(1, t, s, n) for t, s, n in zip(hours(0, 1, 2, 3), "AABA", range(4), strict=True)], "key int, at timestamp, s string, n int")
    versions = history.scd2(log, ["key"], ["at"], ["s"]).orderBy("start_at").collect()
    assert [(v.s, v.start_at, v.end_at) for v in versions] == [("A", T0, hours(2)[0]), ("B", hours(2)[0], hours(3)[0]), ("A", hours(3)[0], None)]


def test_plan_reads():
    present = {"a": {"version": 9, "min_valid": 3, "created": 1}, "b": {"version": 9, "min_valid": 7, "created": 1}, "c": {"version": 9, "min_valid": 0, "created": 2}, "d": {"version": 1, "min_valid": 0, "created": 1}}
    marks = {"a": {"version": 5, "created": 1}, "b": {"version": 5, "created": 1}, "c": {"version": 5, "created": 1}}
    kinds = {r.table: r.kind for r in history.plan_reads(present, marks)}
    assert kinds == {"a": "changes", "b": "snapshot", "c": "snapshot", "d": "snapshot"}


@pytest.mark.parametrize(("value", "points"), [(8, 3), (8.5, 3), (9, 1), (11, 1), (12, 0), (20, 0), (21, 2), (24, 2), (25, 3), (None, None)])
def test_breathing_bands(spark, value, points):
    # 8.5 rounds half-even, to 8
    row = spark.createDataFrame([(None if value is None else float(value),)], "v double").select(bands.band(F.bround("v", 0), *bands.BANDS["resp_rate"]).alias("p")).first()
    assert row.p == points


def test_ranking_quality_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([("a", 0.9, 1), ("a", 0.9, 0), ("a", 0.1, 0), ("a", 0.5, 1), ("b", 0.3, 0), ("a", 0.2, None)], "g string, s double, y int")
    got = {r.g: r for r in metrics.ranking_quality(rows, "s", "y", ["g"]).collect()}
    assert got["a"].auroc == pytest.approx(0.625) and got["a"].auprc == pytest.approx((0.5 + 2 / 3) / 2) and got["b"].auroc is None and got["b"].auprc is None


def test_distances_need_enough_and_grow(spark):
    base = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    same, moved = metrics.distances(base, base, "v").first(), metrics.distances(base, base.select((F.col("v") + 300).alias("v")), "v").first()
    assert same.psi == pytest.approx(0) and same.js == pytest.approx(0) and moved.psi > 1
    assert metrics.distances(base, base.limit(499), "v").first().psi is None


def test_resampling_draws_whole_stays(spark):
    weights = metrics.resampled(spark.range(2000).withColumnRenamed("id", "stay"), "stay", 20)
    mean, spread = weights.agg(F.avg("weight"), F.variance("weight")).first()
    assert mean == pytest.approx(1, abs=0.03) and spread == pytest.approx(1, abs=0.06)


def test_rules_and_guard(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 500.0), (3, None)], "id int, v double")
    rules = {"range": quality.within("v", 0, 100)}
    assert [r.id for r in quality.quarantine(rows, rules).collect()] == [2] and quality.valid(rows, rules).count() == 2
    early, late = (spark.createDataFrame([(t,)], "ts timestamp") for t in hours(1, 5))
    with pytest.raises(ValueError, match="run it first"):
        quality.require_current(late, early, "ts")
    quality.require_current(early, late, "ts")
    none = spark.createDataFrame([], "ts timestamp")
    quality.require_current(none, none, "ts")


GOOD_SQL = (
    "SELECT count(*) FROM scores", "WITH x AS (SELECT * FROM scores) SELECT max(risk) FROM x WHERE risk > (SELECT avg(risk) FROM scores)",
    "SELECT risk, rank() OVER (ORDER BY risk) FROM gold.scores ORDER BY 1 LIMIT 5",
)
BAD_SQL = (
    "", "DROP TABLE scores", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT * FROM parquet.`/etc`", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM range(10)",
    "SELECT * FROM scores WHERE risk IN (SELECT risk FROM hidden)", "SELECT * FROM scores WHERE EXISTS (SELECT 1 FROM hidden)", "INSERT INTO scores VALUES (1)", "SET x = 1", "WITH y AS (SELECT * FROM hidden) SELECT * FROM y",
    "SELECT (SELECT reflect('java.lang.System', 'getenv', 'HOME'))", "SELECT * FROM other.scores", "CACHE TABLE scores",
)


@pytest.mark.parametrize("sql", GOOD_SQL)
def test_guard_lets_through(spark, sql):
    assert sqlguard.vet(spark, f" {sql} ; ", {"scores"}, "gold") == sql


@pytest.mark.parametrize("sql", BAD_SQL)
def test_guard_rejects(spark, sql):
    with pytest.raises(sqlguard.Refused):
        sqlguard.vet(spark, sql, {"scores"}, "gold")


def test_guard_runs_and_caps(spark):
    spark.range(1000).withColumn("risk", F.rand(1)).createOrReplaceTempView("scores")
    assert len(sqlguard.answer(spark, "SELECT * FROM scores", {"scores"}, seconds=60)) == 200
    with pytest.raises(TimeoutError):
        sqlguard.answer(spark, "SELECT sum(a.risk * b.risk + c.risk) FROM scores a CROSS JOIN scores b CROSS JOIN scores c", {"scores"}, seconds=0.5)


def test_snapshot_detects_change(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    expected = ingest.write_snapshot(spark, {"t": spark.range(5)}, folder)
    expected = spark.createDataFrame(expected.collect(), expected.schema)
    ingest.verify_snapshot(spark, folder, expected)
    spark.range(6).write.mode("overwrite").parquet(f"{folder}/t")
    with pytest.raises(ValueError, match="not those"):
        ingest.verify_snapshot(spark, folder, expected)


def test_stream_takes_each_file_once(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    ddl = "id BIGINT, ts TIMESTAMP"
    source = spark.range(10).select("id", F.lit(T0).alias("ts"))
    source.write.json(landing)
    for n in (10, 13):
        streams.drain(streams.deduplicated(streams.json_stream(spark, landing, ddl), ["id"], "ts").select("id"), out, mark)
        assert spark.read.parquet(out).count() == n
        spark.range(8, 13).select("id", F.lit(T0).alias("ts")).write.mode("append").json(landing)


def test_registry(spark, tmp_path):
    r = registry.Registry(spark, f"file://{tmp_path}/models")
    r.promote("m", 1, None, "first")
    r.promote("m", 2, 1, "better", event_id="e")
    r.promote("m", 2, 1, "better", event_id="e")
    with pytest.raises(registry.Refused):
        r.promote("m", 3, 1, "stale")
    assert r.champion("m") == 2 and r.rollback("m", "worse") == 1 and r.champion("m") == 1 and r.audit().count() == 3


def test_what_if_and_chunks(spark):
    row = spark.createDataFrame([(80.0, 80.0, 78.0, 1.0)], "hr_mean_1h double, hr_mean_3h double, hr_mean_6h double, hr_trend_3h double")
    got = model.what_if(row, {"hr": 110}).first()
    assert (got.hr_mean_1h, got.hr_mean_3h, got.hr_mean_6h, got.hr_trend_3h) == (110, 90, 83, 31)
    with pytest.raises(ValueError, match="no vital"):
        model.what_if(row, {"xx": 1})
    with pytest.raises(ValueError, match="acvpu"):
        model.what_if(row, {"acvpu": "X"})
    gap = spark.createDataFrame([(None, None, 78.0, None)], row.schema)
    assert tuple(model.what_if(gap, {"hr": 110}).first()) == (110, 110, 78, None)
    text = "# A\n\n" + "w " * 150 + "\n\n" + "v " * 100 + "\n\n```\ncode\n\nmore\n```\n\n## B\n\nlast"
    assert [s for s, _ in retrieval.chunk_blocks(text, 220, 40)] == ["", "", "B"]
    page = "# T\n\n> **Synthetic notice\n\nintro\n| a |\n| b |\nafter\n## S one\n### Deep, er!\n> **Synthetic stays\n## Two\nend\n#no heading"
    assert retrieval.chunk_blocks(page, 220, 40) == [("", "intro\n\n| a |\n| b |\n\nafter"), ("S one > Deep, er!", "> **Synthetic stays"), ("Two", "end\n#no heading")]
    frame = spark.createDataFrame([("d", "2", page), ("e", "1", None), ("f", "1", text)], "doc string, version string, body string")
    chunks = retrieval.heading_chunks(frame, "doc", "body", "version")
    assert {c.chunk_id for c in chunks.collect()} == {"d@2#intro-0", "d@2#deep-er-1", "d@2#two-2", "f@1#intro-0", "f@1#intro-1", "f@1#b-2"} and retrieval.repeated_ids(chunks).count() == 0
    pages = retrieval.front_matter(spark.createDataFrame([("---\ndoc_id: d\ntitle: T\n---\nx",)], "page string"), "page", retrieval.FIELDS)
    assert retrieval.lacking(pages).first().lacking == ["version", "status", "effective_date"]


def test_trees_learn(spark):
    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) > 9).cast("double").alias("y"))
    scored = model.raw_scores(model.fit_trees(rows, ["x"], "y", rounds=3), rows)
    curve = model.calibrated(model.fit_calibration(scored, "y"), scored)
    low, high = (curve.where(c).agg(F.max("risk"), F.min("risk")).first() for c in ("x < 5", "x > 14"))
    assert low[0] < high[1] and 0 < low[1] and high[0] <= 1


def test_driver_gives_native_memory_back(spark):
    """The JVM is asked to trim each time that executors and driver collect, by a name that it has."""
    said, ask = [], session.jvm_command
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(session, "jvm_command", lambda *a: said.append(ask(*a)))
        session.settle(spark)
    assert len(said) == 1 and "Trim native heap" in said[0]
