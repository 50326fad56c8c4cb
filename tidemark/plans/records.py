"""Queries on records: rules, quarantine, change logs, versions, set operations, relational forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history, quality
from tidemark.plans.catalogue import register
from tidemark.sources.tables import table

RULES = {
    "has_id": quality.present("event_id", "ts"),
    "value_range": quality.within("value", 1, 80),
    "known_type": quality.one_of("event_type", "view", "click", "purchase", "signup"),
    "small_k": "coalesce(CAST(get_json_object(props, '$.k') AS INT) < 90, false)",
}
DUCK_RULES = {
    "has_id": "event_id IS NOT NULL AND ts IS NOT NULL",
    "value_range": "(value IS NULL OR value BETWEEN 1 AND 80)",
    "known_type": "coalesce(event_type IN ('view', 'click', 'purchase', 'signup'), false)",
    "small_k": "coalesce(CAST(json_extract_string(props, '$.k') AS INT) < 90, false)",
}


@register("valid_rows", f"SELECT event_id, value FROM events WHERE {' AND '.join(DUCK_RULES.values())}")
def valid_rows(spark, sf_dir):
    return quality.valid(table(spark, sf_dir, "events"), RULES).select("event_id", "value")


@register(
    "quarantined_rows",
    f"""
    SELECT event_id, failed_rules FROM (SELECT event_id, concat_ws(',', {', '.join(f"CASE WHEN NOT ({r}) THEN '{n}' END" for n, r in DUCK_RULES.items())}) AS failed_rules FROM events)
    WHERE failed_rules <> ''
    """,
)
def quarantined_rows(spark, sf_dir):
    return quality.quarantine(table(spark, sf_dir, "events"), RULES).select("event_id", F.array_join("failed_rules", ",").alias("failed_rules"))


@register(
    "rule_report",
    " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(count(*) FILTER (WHERE NOT ({r})) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE {r}) AS BIGINT) AS passed FROM events" for n, r in DUCK_RULES.items()),
)
def rule_report(spark, sf_dir):
    return quality.rule_report(table(spark, sf_dir, "events"), RULES)


RAW = "raw AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)"
GOOD = " AND ".join(DUCK_RULES.values())


@register(
    "reconciliation",
    f"""
    WITH {RAW}, good AS (SELECT event_id FROM raw WHERE {GOOD}), stored AS (SELECT DISTINCT event_id FROM good WHERE event_id % 7 <> 0),
    linked AS (SELECT event_id FROM stored WHERE event_id % 2 = 0)
    SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM raw WHERE NOT ({GOOD})) AS quarantined,
           (SELECT count(*) - count(DISTINCT event_id) FROM good) AS duplicates,
           (SELECT count(DISTINCT event_id) FROM good WHERE event_id NOT IN (SELECT event_id FROM stored)) AS missing,
           (SELECT count(*) FROM stored) AS stored, (SELECT count(*) FROM linked) AS linked,
           (SELECT count(*) FROM stored) - (SELECT count(*) FROM linked) AS unlinked
    """,
)
def reconciliation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = events.unionByName(events.where("event_id % 10 = 0"))
    stored = quality.deduplicated(quality.valid(raw, RULES), ["event_id"]).where("event_id % 7 <> 0").select("event_id")
    return quality.reconcile(raw, stored, stored.where("event_id % 2 = 0"), RULES, ["event_id"])


@register("missing_shares", "SELECT 'w' AS field, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS share FROM events UNION ALL SELECT 'value', 0.0")
def missing_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("w", F.when(F.col("value") <= 50, F.col("value")))
    return quality.missing_shares(rows, ["w", "value"]).select("field", F.round("share", 6).alias("share"))


def change_log(spark, sf_dir):
    """Orders as versions of their customer: a log with a version number."""
    orders = table(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderkey") % 5 == 0, "I").otherwise("U")
    return orders.select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("version"), op.alias("change_op"))


LOG = """log AS (SELECT o_custkey AS key, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS changed_at, o_orderkey AS version,
    CASE WHEN o_orderkey % 5 = 0 THEN 'I' ELSE 'U' END AS change_op FROM orders)"""


@register("scd1_current", f"WITH {LOG} SELECT key, status, version FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY changed_at DESC, version DESC) = 1")
def scd1_current(spark, sf_dir):
    return history.scd1(change_log(spark, sf_dir), ["key"], ["changed_at", "version"]).select("key", "status", "version")


VERSIONS = f"""{LOG}, c AS (SELECT *, lag(status) OVER w IS DISTINCT FROM status OR row_number() OVER w = 1 AS new FROM log WINDOW w AS (PARTITION BY key ORDER BY changed_at, version)),
    v AS (SELECT key, status, version, changed_at AS start_at, lead(changed_at) OVER (PARTITION BY key ORDER BY changed_at, version) AS end_at FROM c WHERE new)"""


@register("scd2_history", f"WITH {VERSIONS} SELECT * FROM v")
def scd2_history(spark, sf_dir):
    return history.scd2(change_log(spark, sf_dir), ["key"], ["changed_at", "version"], ["status"]).select("key", "status", "version", "start_at", "end_at")


@register("scd2_current", f"WITH {VERSIONS} SELECT key, status FROM v WHERE end_at IS NULL")
def scd2_current(spark, sf_dir):
    return history.current(history.scd2(change_log(spark, sf_dir), ["key"], ["changed_at", "version"], ["status"])).select("key", "status")


@register("scd2_as_of", f"WITH {VERSIONS} SELECT key, status FROM v WHERE start_at <= TIMESTAMP '1998-01-01' AND (end_at IS NULL OR end_at > TIMESTAMP '1998-01-01')")
def scd2_as_of(spark, sf_dir):
    return history.as_of(history.scd2(change_log(spark, sf_dir), ["key"], ["changed_at", "version"], ["status"]), "1998-01-01").select("key", "status")


@register(
    "upsert",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 1000000 ELSE 0 END, 0.0 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1"
    " UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000, 0.0 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0",
)
def upsert(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey"))
    return history.upsert(target, target.where("c_custkey % 3 = 0").select(key.alias("c_custkey"), F.lit(0.0).alias("c_acctbal")), ["c_custkey"])


@register(
    "late_fill",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality FROM labels WHERE doc_id % 7 <> 0"
    " UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0",
)
def late_fill(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    target = labels.where("doc_id % 7 <> 0").withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    return history.fill_late(target, labels.where("doc_id % 5 <> 0"), ["doc_id"], "quality")


@register(
    "state_difference",
    "SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 THEN 'added' WHEN p_partkey % 10 = 2 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 10 IN (1, 2) OR p_partkey % 10 = 3 AND p_size <> 7",
)
def state_difference(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    new = part.where("p_partkey % 10 <> 2").withColumn("p_size", F.when(F.col("p_partkey") % 10 == 3, 7).otherwise(F.col("p_size")))
    return history.difference(part.where("p_partkey % 10 <> 1"), new, ["p_partkey"], ["p_size", "p_brand"])


@register("changes_between", f"WITH {LOG} SELECT l.key, l.version, c.c_name FROM log l LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON l.key = c.c_custkey WHERE version > 1000 AND version <= 4000")
def changes_between(spark, sf_dir):
    state = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("key"), "c_name")
    return history.changes_between(change_log(spark, sf_dir), state, ["key"], "version", 1000, 4000).select("key", "version", "c_name")


@register("first_copies", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_copies(spark, sf_dir):
    return history.first_copy(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("latest_watermarks", "SELECT event_type AS table_name, max_by(event_id, ts) AS version FROM events GROUP BY 1")
def latest_watermarks(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select(F.col("event_type").alias("table_name"), "ts", F.col("event_id").alias("version"))
    return history.latest_marks(marks, "table_name", "ts").select("table_name", "version")


@register("op_counts", f"WITH {LOG} SELECT change_op, CAST(count(*) AS BIGINT) AS n FROM log WHERE change_op <> 'D' GROUP BY 1")
def op_counts(spark, sf_dir):
    return history.no_deletes(change_log(spark, sf_dir)).groupBy("change_op").agg(F.count("*").alias("n"))


@register("left_join_unknown", "SELECT o.o_orderkey, c.c_mktsegment FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def left_join_unknown(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(rich, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@register("anti_join_unscored", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_unscored(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@register("not_in_null_aware", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def not_in_null_aware(spark, sf_dir):
    frames = {"s": table(spark, sf_dir, "supplier"), "c": table(spark, sf_dir, "customer")}
    return spark.sql("SELECT s_suppkey FROM {s} WHERE s_nationkey NOT IN (SELECT c_nationkey FROM {c} WHERE c_acctbal > 9900)", **frames)


@register("semi_join_having", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def semi_join_having(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    busy = orders.groupBy("o_custkey").count().where("count > 12")
    return orders.join(busy, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register(
    "full_outer_days",
    """
    WITH a AS (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS ordered FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT date_trunc('day', l_shipdate) AS day, count(*) AS shipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT day, CAST(ordered AS BIGINT) AS ordered, CAST(shipped AS BIGINT) AS shipped FROM a FULL JOIN b USING (day)
    """,
)
def full_outer_days(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("ordered"))
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.date_trunc("day", "l_shipdate").alias("day")).agg(F.count("*").alias("shipped"))
    return a.join(b, "day", "full")


@register("one_row_stitching", "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers, (SELECT max(ts) FROM events) AS last_event")
def one_row_stitching(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"))
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("n_customers"))
    return orders.crossJoin(customers).crossJoin(table(spark, sf_dir, "events").agg(F.max("ts").alias("last_event")))


@register("or_join_label_or_id", "SELECT o_orderkey, c_custkey FROM orders JOIN (SELECT * FROM customer WHERE c_custkey = 7) c ON o_custkey = c_custkey OR o_orderkey = c_custkey")
def or_join_label_or_id(spark, sf_dir):
    one = table(spark, sf_dir, "customer").where("c_custkey = 7")
    orders, key = table(spark, sf_dir, "orders"), F.col("c_custkey")
    # an OR of equalities as two hash joins: rows that meet both ways are kept once
    a = orders.join(one, F.col("o_custkey") == key).select("o_orderkey", "c_custkey")
    b = orders.join(one, (F.col("o_orderkey") == key) & ~(F.col("o_custkey") == key)).select("o_orderkey", "c_custkey")
    return a.unionByName(b)


@register("three_left_joins", "SELECT c.c_custkey, n.n_name, r.r_name, CAST(o.n AS BIGINT) AS n_orders FROM customer c LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def three_left_joins(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", "r_name", "n_orders")


@register("union_distinct_keys", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def union_distinct_keys(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.unionByName(b).distinct()


@register("key_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def key_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey").distinct().join(lines.where("l_returnflag = 'A'"), "l_partkey", "left_anti")


@register("key_intersection", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def key_intersection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey").distinct().join(lines.where("l_returnflag = 'A'"), "l_partkey", "left_semi")


@register("exclusion_windows", "SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM (VALUES (3, TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-05'), (NULL, TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11')) x(u, a, b) WHERE (u IS NULL OR u = user_id) AND ts BETWEEN a AND b)")
def exclusion_windows(spark, sf_dir):
    known = spark.sql("SELECT * FROM VALUES (3L, TIMESTAMP_NTZ '2024-01-02', TIMESTAMP_NTZ '2024-01-05'), (NULL, TIMESTAMP_NTZ '2024-01-10', TIMESTAMP_NTZ '2024-01-11') AS x(u, a, b)")
    inside = (F.col("u").isNull() | (F.col("u") == F.col("user_id"))) & F.col("ts").between(F.col("a"), F.col("b"))
    return table(spark, sf_dir, "events").join(F.broadcast(known), inside, "left_anti").select("event_id")  # two rows


@register("masked_view", "SELECT c_custkey, 'P-' || CAST(1000 + row_number() OVER (ORDER BY c_acctbal, c_custkey) AS VARCHAR) AS label, c_mktsegment FROM customer")
def masked_view(spark, sf_dir):
    from tidemark.functions.ranking import dense_number

    rows = dense_number(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal", "c_custkey"], "n")
    return rows.select("c_custkey", F.concat(F.lit("P-"), (F.col("n") + 1000).cast("string")).alias("label"), "c_mktsegment")
