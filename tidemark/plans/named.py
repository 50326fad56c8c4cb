"""Parameterised SQL over scored logs, and the endpoints that run it.

The texts take DataFrames by name ({log}, {alerts}, ...) and parameters (:as_of, :site, ...). An optional parameter is
null for "all": Spark folds the test away when it binds the value.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row

from tidemark.plans import signals
from tidemark.plans.catalogue import ORACLES, register
from tidemark.sources.tables import table

OF_SITE = "(CAST(:site AS BIGINT) IS NULL OR site = :site)"

SUMMARY = f"""
    SELECT (SELECT count(*) FROM {{log}} WHERE day_at = timestamp(:as_of) AND {OF_SITE}) AS census,
           (SELECT count_if(high) FROM {{log}} WHERE day_at = timestamp(:as_of) AND {OF_SITE}) AS high_risk,
           (SELECT coalesce(sum(alerts), 0) FROM {{kpis}} WHERE day_at > timestamp(:as_of) - INTERVAL 3 DAYS AND day_at <= timestamp(:as_of) AND {OF_SITE}) AS recent_alerts,
           (SELECT round(try_divide(sum(alerts) * :patients_per_nurse * :shift_hours, sum(census)), 6) FROM {{kpis}}
             WHERE day_at > timestamp(:as_of) - INTERVAL 3 DAYS AND day_at <= timestamp(:as_of) AND {OF_SITE}) AS alerts_per_nurse_shift,
           (SELECT round(avg(escalated), 6) FROM {{alerts}} WHERE alert_at > timestamp(:as_of) - INTERVAL 7 DAYS AND alert_at <= timestamp(:as_of) AND {OF_SITE}) AS alert_precision,
           (SELECT count(escalated) FROM {{alerts}} WHERE alert_at > timestamp(:as_of) - INTERVAL 7 DAYS AND alert_at <= timestamp(:as_of) AND {OF_SITE}) AS alerts_with_outcome,
           (SELECT round(median(hours_flagged), 2) FROM {{escalations}} WHERE event_at > timestamp(:as_of) - INTERVAL 7 DAYS AND event_at <= timestamp(:as_of) AND {OF_SITE}) AS median_hours_flagged
"""
CENSUS = f"""
    SELECT day_at, site, sum(census) AS census, sum(n_low) AS n_low, sum(n_high) AS n_high, sum(alerts) AS alerts, sum(escalations) AS escalations
    FROM {{kpis}} WHERE day_at > timestamp(:as_of) - :days * INTERVAL 1 DAY AND day_at <= timestamp(:as_of) AND {OF_SITE} GROUP BY day_at, site ORDER BY day_at, site
"""
UNITS = f"SELECT site, unit, census, n_low, n_high, round(mean_score, 2) AS mean_score FROM {{kpis}} WHERE day_at = timestamp(:as_of) AND {OF_SITE} ORDER BY site, unit"
ALERTS_DAILY = f"""
    SELECT date_trunc('day', alert_at) AS day, site, count(*) AS alerts, count_if(escalated = 1) AS followed, count_if(escalated = 0) AS not_followed, count_if(escalated IS NULL) AS pending
    FROM {{alerts}} WHERE alert_at > timestamp(:as_of) - :days * INTERVAL 1 DAY AND alert_at <= timestamp(:as_of) AND {OF_SITE} GROUP BY 1, 2 ORDER BY 1, 2
"""
DEVICES = """
    SELECT day, count(*) AS devices, round(avg(uptime), 2) AS uptime, sum(outages) AS outages, sum(stuck_minutes) AS stuck_minutes, count(DISTINCT kinds) AS kinds, max(kinds) AS last_kind
    FROM {devices} WHERE expected > 0 AND day > timestamp(:as_of) - :days * INTERVAL 1 DAY AND day <= timestamp(:as_of) GROUP BY 1 ORDER BY 1
"""
BOARD = f"""
    SELECT r.stay, c.c_name, r.site, r.unit, r.risk, r.high, r.score, earlier.risk AS risk_before
    FROM {{log}} r JOIN {{customers}} c ON c.c_custkey = r.stay LEFT JOIN {{log}} earlier ON earlier.stay = r.stay AND earlier.day_at = timestamp(:as_of) - INTERVAL 1 DAY
    WHERE r.day_at = timestamp(:as_of) AND {OF_SITE.replace('site =', 'r.site =')} AND (CAST(:unit AS BIGINT) IS NULL OR r.unit = :unit) AND (CAST(:high AS BOOLEAN) IS NULL OR r.high = :high)
    ORDER BY r.risk DESC, r.score DESC, r.stay LIMIT :limit
"""
STAY_SERIES = "SELECT day_at, risk, high, score, unit FROM {log} WHERE stay = :stay AND day_at > timestamp(:as_of) - :days * INTERVAL 1 DAY AND day_at <= timestamp(:as_of) ORDER BY day_at"
STAY_ALERTS = "SELECT alert_at, risk, escalated, hours_to_event FROM {alerts} WHERE stay = :stay AND alert_at <= timestamp(:as_of) ORDER BY alert_at"
NOW = "SELECT min(day_at) AS first_at, max(day_at) AS last_at FROM {log}"
EXPLAIN = """
    WITH latest AS (SELECT stay, max(day_at) AS day_at FROM {log} WHERE stay = CAST(regexp_extract(trim(:stay), '[0-9]+', 0) AS BIGINT) GROUP BY stay)
    SELECT l.stay, l.day_at, l.risk, l.high, before.risk AS risk_before, l.day_at = (SELECT max(day_at) FROM {log}) AS here_now, coalesce(a.recent, '[]') AS recent
    FROM latest JOIN {log} l USING (stay, day_at) LEFT JOIN {log} before ON before.stay = l.stay AND before.day_at = l.day_at - INTERVAL 1 DAY
    LEFT JOIN (SELECT a.stay, to_json(array_sort(collect_list(named_struct('at', date_format(alert_at, 'yyyy-MM-dd'), 'escalated', escalated)))) AS recent
               FROM {alerts} a JOIN latest ON a.stay = latest.stay AND a.alert_at > latest.day_at - INTERVAL 20 DAYS AND a.alert_at <= latest.day_at GROUP BY a.stay) a ON a.stay = l.stay
"""


class Facts:
    """The tables that the texts read, made once for a folder, and a small cache of answers.

    Answers are kept for `max_age` seconds, `keep` of them. If a table can't be read and there is a snapshot, it answers,
    as of its own last step; `stale` says so.
    """

    def __init__(self, spark, sf_dir: str, keep: int = 256, max_age: float = 3600.0, snapshot: Facts | None = None):
        self.spark, self.max_age, self.snapshot, self.stale = spark, max_age, snapshot, False
        log = signals.score_log(spark, sf_dir)
        self.frames = {
            "log": log.withColumnRenamed("at", "day_at"),
            "alerts": signals.alert_rows(spark, sf_dir),
            "escalations": signals.escalations_fact(spark, sf_dir),
            "kpis": signals.kpi_cube(spark, sf_dir),
            "devices": signals.device_health(spark, sf_dir),
            "customers": table(spark, sf_dir, "customer"),
        }
        self.answers: OrderedDict[tuple, tuple[float, list[Row]]] = OrderedDict()
        self.keep = keep

    def query(self, text: str, **parameters) -> DataFrame:
        """The answer as a DataFrame. Only the tables and parameters that the text names are bound."""
        frames = {n: f for n, f in self.frames.items() if f"{{{n}}}" in text}
        return self.spark.sql(text, args={n: v for n, v in parameters.items() if f":{n}" in text}, **frames)

    def rows(self, text: str, **parameters) -> list[Row]:
        """The answer's rows, from the cache if it was asked before."""
        key = (text, tuple(sorted(parameters.items(), key=lambda p: p[0])))
        asked, answer = self.answers.get(key, (0.0, None))
        if answer is None or time.monotonic() - asked > self.max_age:
            try:
                answer, self.stale = self.query(text, **parameters).collect(), False
            except PySparkException:
                if self.snapshot is None:
                    raise
                if "as_of" in parameters:
                    last = self.snapshot.rows(NOW)[0].last_at
                    parameters |= {"as_of": min(str(last), str(parameters["as_of"]))}
                self.stale = True
                return self.snapshot.rows(text, **parameters)
            self.answers[key] = time.monotonic(), answer
            while len(self.answers) > self.keep:
                self.answers.popitem(last=False)
        self.answers.move_to_end(key)
        return answer


DAY = "2024-01-15"
LOG = signals.LOG
KPIS = """base AS (
        SELECT site, unit, day_at, count(DISTINCT stay) AS census, count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE NOT high) AS n_low, round(avg(score), 4) AS mean_score FROM log GROUP BY 1, 2, 3
    ), raised AS (SELECT site, unit, alert_at AS day_at, count(*) AS n FROM alerts GROUP BY 1, 2, 3),
    placed AS (SELECT l.site, l.unit, date_trunc('day', o.event_at) AS day_at, count(*) AS n
        FROM (SELECT *, date_trunc('day', event_at) AS slot FROM outcomes) o ASOF JOIN log l ON o.stay = l.stay AND o.slot >= l.day_at GROUP BY 1, 2, 3),
    kpis AS (SELECT site, unit, day_at, census, n_high, n_low, mean_score, coalesce(raised.n, 0) AS alerts, coalesce(placed.n, 0) AS escalations
        FROM base LEFT JOIN raised USING (site, unit, day_at) LEFT JOIN placed USING (site, unit, day_at)),
    esc AS (SELECT o.stay, event_at, max_by(site, day_at) AS site, round(epoch(event_at - min(day_at) FILTER (WHERE high AND day_at >= event_at - INTERVAL 72 HOUR)) / 3600, 4) AS hours_flagged
        FROM outcomes o JOIN log l ON o.stay = l.stay AND day_at < event_at WHERE event_at <= TIMESTAMP '2024-01-25' GROUP BY 1, 2)"""
T = f"TIMESTAMP '{DAY}'"


def _named(name: str, text: str, sql: str, **parameters) -> Callable:
    @register(name, f"WITH RECURSIVE {LOG}, {KPIS} {sql}")
    def query(spark, sf_dir):
        return Facts(spark, sf_dir).query(text, as_of=DAY, **parameters)

    return query


summary = _named(
    "named_summary", SUMMARY,
    f"""SELECT (SELECT count(*) FROM log WHERE day_at = {T} AND site = 1) AS census, (SELECT count(*) FILTER (WHERE high) FROM log WHERE day_at = {T} AND site = 1) AS high_risk,
    (SELECT CAST(coalesce(sum(alerts), 0) AS BIGINT) FROM kpis WHERE day_at > {T} - INTERVAL 3 DAY AND day_at <= {T} AND site = 1) AS recent_alerts,
    (SELECT round(sum(alerts) * 60.0 / sum(census), 6) FROM kpis WHERE day_at > {T} - INTERVAL 3 DAY AND day_at <= {T} AND site = 1) AS alerts_per_nurse_shift,
    (SELECT round(avg(escalated), 6) FROM alerts WHERE alert_at > {T} - INTERVAL 7 DAY AND alert_at <= {T} AND site = 1) AS alert_precision,
    (SELECT count(escalated) FROM alerts WHERE alert_at > {T} - INTERVAL 7 DAY AND alert_at <= {T} AND site = 1) AS alerts_with_outcome,
    (SELECT round(median(hours_flagged), 2) FROM esc WHERE event_at > {T} - INTERVAL 7 DAY AND event_at <= {T} AND site = 1) AS median_hours_flagged""",
    site=1, patients_per_nurse=5, shift_hours=12,
)
census = _named(
    "named_census", CENSUS,
    f"""SELECT day_at, site, CAST(sum(census) AS BIGINT) AS census, CAST(sum(n_low) AS BIGINT) AS n_low, CAST(sum(n_high) AS BIGINT) AS n_high, CAST(sum(alerts) AS BIGINT) AS alerts,
    CAST(sum(escalations) AS BIGINT) AS escalations FROM kpis WHERE day_at > {T} - INTERVAL 5 DAY AND day_at <= {T} GROUP BY 1, 2""",
    site=None, days=5,
)
units = _named("named_units", UNITS, f"SELECT site, unit, census, n_low, n_high, round(mean_score, 2) AS mean_score FROM kpis WHERE day_at = {T}", site=None)
alerts_daily = _named(
    "named_alerts_daily", ALERTS_DAILY,
    f"""SELECT date_trunc('day', alert_at) AS day, site, count(*) AS alerts, count(*) FILTER (WHERE escalated = 1) AS followed, count(*) FILTER (WHERE escalated = 0) AS not_followed,
    count(*) FILTER (WHERE escalated IS NULL) AS pending FROM alerts WHERE alert_at > {T} - INTERVAL 14 DAY AND alert_at <= {T} GROUP BY 1, 2""",
    site=None, days=14,
)
board = _named(
    "named_board", BOARD,
    f"""SELECT r.stay, c_name, r.site, r.unit, r.risk, r.high, r.score, e.risk AS risk_before FROM log r JOIN customer ON c_custkey = r.stay LEFT JOIN log e ON e.stay = r.stay AND e.day_at = {T} - INTERVAL 1 DAY
    WHERE r.day_at = {T} AND r.site = 2 AND r.high ORDER BY r.risk DESC, r.score DESC, r.stay LIMIT 20""",
    site=2, unit=None, high=True, limit=20,
)
stay_series = _named("named_stay_series", STAY_SERIES, f"SELECT day_at, risk, high, score, unit FROM log WHERE stay = 5 AND day_at > {T} - INTERVAL 10 DAY AND day_at <= {T}", stay=5, days=10)
stay_alerts = _named("named_stay_alerts", STAY_ALERTS, f"SELECT alert_at, risk, escalated, hours_to_event FROM (SELECT * FROM alerts) WHERE stay = 5 AND alert_at <= {T}", stay=5)
now = _named("named_now", NOW, "SELECT min(day_at) AS first_at, max(day_at) AS last_at FROM log")
explain = _named(
    "named_explain", EXPLAIN,
    """, latest AS (SELECT max(day_at) AS d FROM log WHERE stay = 9) SELECT l.stay, l.day_at, l.risk, l.high, b.risk AS risk_before, l.day_at = (SELECT max(day_at) FROM log) AS here_now,
    coalesce((SELECT '[' || string_agg('{"at":"' || strftime(alert_at, '%Y-%m-%d') || '"' || CASE WHEN escalated IS NULL THEN '' ELSE ',"escalated":' || escalated END || '}', ',' ORDER BY alert_at) || ']'
      FROM alerts, latest WHERE stay = 9 AND alert_at > d - INTERVAL 20 DAY AND alert_at <= d), '[]') AS recent
    FROM latest JOIN log l ON l.stay = 9 AND l.day_at = d LEFT JOIN log b ON b.stay = 9 AND b.day_at = d - INTERVAL 1 DAY""",
    stay=" p-9 ",
)


@register(
    "named_devices",
    f"WITH x AS ({ORACLES['device_health']})" + """
    SELECT day, count(*) AS devices, round(avg(uptime), 2) AS uptime, CAST(sum(outages) AS BIGINT) AS outages, CAST(sum(stuck_minutes) AS BIGINT) AS stuck_minutes,
           count(DISTINCT kinds) AS kinds, max(kinds) AS last_kind FROM x WHERE expected > 0 AND day > TIMESTAMP '2024-01-15' - INTERVAL 14 DAY AND day <= TIMESTAMP '2024-01-15' GROUP BY 1
    """,
)
def devices(spark, sf_dir):
    return Facts(spark, sf_dir).query(DEVICES, as_of=DAY, days=14)


@register("explain_function", f"WITH RECURSIVE {LOG} SELECT day_at, risk, high FROM log WHERE stay = 12 ORDER BY day_at DESC LIMIT 1")
def explain_function(spark, sf_dir):
    """A SQL table function over a view: the latest row of a stay, asked for as P-12, p12 or 12."""
    signals.score_log(spark, sf_dir).withColumnRenamed("at", "day_at").createOrReplaceTempView("tidemark_log")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tidemark_explain(asked STRING) RETURNS TABLE (day_at TIMESTAMP, risk DOUBLE, high BOOLEAN) RETURN "
        "SELECT max_by(l.day_at, l.day_at), max_by(l.risk, l.day_at), max_by(l.high, l.day_at) FROM tidemark_log l WHERE l.stay = CAST(regexp_extract(trim(asked), '[0-9]+', 0) AS BIGINT)"
    )
    return spark.sql("SELECT * FROM tidemark_explain(' P-12 ')")
