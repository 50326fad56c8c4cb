"""Named measures, filters and joins over the facts, and questions that are put together from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from tidemark.plans.catalogue import register
from tidemark.plans.named import DAY, KPIS, LOG, Facts, T


@dataclass(frozen=True)
class Measure:
    """A number over a table of facts."""

    table: str
    sql: str
    means: str


MEASURES = {
    "alerts_per_nurse_per_shift": Measure("kpis", "round(sum(kpis.alerts) * 60.0 / sum(kpis.census), 6)", "alerts a nurse of 5 patients gets in 12 hours"),
    "alert_precision": Measure("alerts", "round(avg(alerts.escalated), 6)", "share of alerts that an event followed, of those whose outcome is known"),
    "share_flagged": Measure("escalations", "round(avg(CASE WHEN escalations.flagged THEN 1.0D ELSE 0.0D END), 6)", "share of events flagged in advance"),
    "device_uptime": Measure("devices", "round(avg(devices.uptime), 6)", "uptime in per cent of devices that were worn"),
}
FILTERS = {
    "now": "log.day_at = (SELECT max(latest.day_at) FROM {log} AS latest)",
    "high": "log.high",
    "worn": "devices.expected > 0",
}
#: (left, right): condition. Many rows of the left have one of the right.
JOINS = {
    ("alerts", "customers"): "alerts.stay = customers.c_custkey",
    ("escalations", "customers"): "escalations.stay = customers.c_custkey",
    ("log", "customers"): "log.stay = customers.c_custkey",
    ("devices", "customers"): "devices.user_id = customers.c_custkey",
    ("alerts", "log"): "alerts.stay = log.stay AND alerts.alert_at = log.day_at",
}


def question(measure: str, by: Sequence[str] = (), filters: Sequence[str] = (), join: str | None = None) -> str:
    """SQL text of a measure by columns, with named filters, and with one more table for what they need."""
    m = MEASURES[measure]
    source = f"{{{m.table}}} AS {m.table}"
    if join is not None:
        source += f" JOIN {{{join}}} AS {join} ON {JOINS[m.table, join]}"
    where = f" WHERE {' AND '.join(FILTERS[f] for f in filters)}" if filters else ""
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {''.join(f'{b}, ' for b in by)}{m.sql} AS {measure} FROM {source}{where}{group}"


def _asked(name: str, text: str, sql: str):
    @register(name, f"WITH RECURSIVE {LOG}, {KPIS} {sql}")
    def query(spark, sf_dir):
        return Facts(spark, sf_dir).query(text, as_of=DAY)

    return query


ESCALATED = """, x AS (SELECT o.stay, event_at, max_by(site, day_at) AS site, count(*) FILTER (WHERE high AND day_at >= event_at - INTERVAL 72 HOUR) > 0 AS flagged
    FROM outcomes o JOIN log l ON o.stay = l.stay AND day_at < event_at WHERE event_at <= TIMESTAMP '2024-01-25' GROUP BY 1, 2)"""

_asked("measure_alert_load", question("alerts_per_nurse_per_shift", ["site"]), "SELECT site, round(sum(alerts) * 60.0 / sum(census), 6) AS alerts_per_nurse_per_shift FROM kpis GROUP BY 1")
_asked(
    "measure_alert_precision", question("alert_precision", ["c_mktsegment"], join="customers"),
    "SELECT c_mktsegment, round(avg(escalated), 6) AS alert_precision FROM alerts JOIN customer ON stay = c_custkey GROUP BY 1",
)
_asked("measure_share_flagged", question("share_flagged", ["site"]), f"{ESCALATED} SELECT site, round(avg(CASE WHEN flagged THEN 1.0 ELSE 0.0 END), 6) AS share_flagged FROM x GROUP BY 1")

#: Questions as their texts, over the named tables.
NOW = "now AS (SELECT max(day_at) AS ts FROM {log})"
HIGH_BY_SITE = f"SELECT log.site, count(*) AS stays, sum(CASE WHEN {FILTERS['high']} THEN 1 ELSE 0 END) AS high_risk FROM {{log}} AS log WHERE {FILTERS['now']} GROUP BY log.site"
HIGHEST = f"SELECT c_name, log.site, log.unit, round(100 * log.risk, 1) AS risk_percent, log.high, log.score FROM {{log}} AS log JOIN {{customers}} AS customers ON {JOINS['log', 'customers']} WHERE {FILTERS['now']} ORDER BY log.risk DESC, log.stay LIMIT 10"
BY_UNIT = f"WITH {NOW} SELECT site, unit, count(*) AS alerts FROM {{alerts}} CROSS JOIN now WHERE alert_at > ts - INTERVAL 14 DAYS AND alert_at <= ts GROUP BY site, unit ORDER BY alerts DESC"
LOAD = f"WITH {NOW} SELECT site, round(sum(alerts) * 60.0 / sum(census), 2) AS load FROM {{kpis}} CROSS JOIN now WHERE day_at > ts - INTERVAL 7 DAYS AND day_at <= ts GROUP BY site ORDER BY site"
FLAGGED = f"WITH {NOW} SELECT site, count(*) AS escalations, sum(CASE WHEN flagged THEN 1 ELSE 0 END) AS in_advance, round(100 * avg(CASE WHEN flagged THEN 1.0D ELSE 0.0D END), 1) AS percent FROM {{escalations}} CROSS JOIN now WHERE event_at > ts - INTERVAL 14 DAYS AND event_at <= ts GROUP BY site ORDER BY site"
DAILY = f"WITH {NOW} SELECT date_trunc('DAY', alert_at) AS day, count(*) AS alerts, sum(CASE WHEN escalated = 1 THEN 1 ELSE 0 END) AS followed, sum(CASE WHEN escalated IS NULL THEN 1 ELSE 0 END) AS pending FROM {{alerts}} CROSS JOIN now WHERE alert_at >= date_trunc('DAY', ts) - INTERVAL 14 DAYS AND alert_at < date_trunc('DAY', ts) GROUP BY date_trunc('DAY', alert_at) ORDER BY day"
UPTIME = f"WITH {NOW} SELECT devices.user_id % 3 AS site, count(DISTINCT devices.user_id) AS worn, round(avg(uptime), 2) AS uptime, sum(outages) AS outages, sum(stuck_minutes) AS stuck_minutes FROM {{devices}} AS devices CROSS JOIN now WHERE {FILTERS['worn']} AND day > ts - INTERVAL 60 DAYS AND day <= ts GROUP BY 1 ORDER BY 1"
MEANS = f"WITH {NOW} SELECT date_trunc('DAY', day_at) AS day, site, round(avg(risk), 4) AS mean_risk, round(avg(score), 4) AS mean_score FROM {{log}} CROSS JOIN now WHERE day_at >= date_trunc('DAY', ts) - INTERVAL 7 DAYS AND day_at < date_trunc('DAY', ts) GROUP BY date_trunc('DAY', day_at), site ORDER BY day, site"

N = ", n AS (SELECT max(day_at) AS ts FROM log)"
_asked("question_high_by_site", HIGH_BY_SITE, f"{N} SELECT site, count(*) AS stays, CAST(sum(high::INT) AS BIGINT) AS high_risk FROM log, n WHERE day_at = ts GROUP BY 1")
_asked("question_highest_risk", HIGHEST, f"{N} SELECT c_name, site, unit, round(100 * risk, 1) AS risk_percent, high, score FROM log JOIN customer ON stay = c_custkey, n WHERE day_at = ts ORDER BY risk DESC, stay LIMIT 10")
_asked("question_alerts_by_unit", BY_UNIT, f"{N} SELECT site, unit, count(*) AS alerts FROM alerts, n WHERE alert_at > ts - INTERVAL 14 DAY AND alert_at <= ts GROUP BY 1, 2")
_asked("question_load", LOAD, f"{N} SELECT site, round(sum(alerts) * 60.0 / sum(census), 2) AS load FROM kpis, n WHERE day_at > ts - INTERVAL 7 DAY AND day_at <= ts GROUP BY 1")
_asked(
    "question_flagged", FLAGGED,
    f"{ESCALATED} {N} SELECT site, count(*) AS escalations, CAST(sum(flagged::INT) AS BIGINT) AS in_advance, round(100 * avg(flagged::INT), 1) AS percent FROM x, n WHERE event_at > ts - INTERVAL 14 DAY AND event_at <= ts GROUP BY 1",
)
_asked(
    "question_alerts_daily", DAILY,
    f"""{N} SELECT date_trunc('day', alert_at) AS day, count(*) AS alerts, CAST(sum((escalated IS NOT DISTINCT FROM 1)::INT) AS BIGINT) AS followed, CAST(sum((escalated IS NULL)::INT) AS BIGINT) AS pending
    FROM alerts, n WHERE alert_at >= date_trunc('day', ts) - INTERVAL 14 DAY AND alert_at < date_trunc('day', ts) GROUP BY 1""",
)
_asked("question_means", MEANS, f"{N} SELECT date_trunc('day', day_at) AS day, site, round(avg(risk), 4) AS mean_risk, round(avg(score), 4) AS mean_score FROM log, n WHERE day_at >= date_trunc('day', ts) - INTERVAL 7 DAY AND day_at < date_trunc('day', ts) GROUP BY 1, 2")


def _devices() -> None:
    """The questions on devices, whose table has a twin of its own."""
    from tidemark.plans.catalogue import ORACLES

    x = f"d AS ({ORACLES['device_health']})"

    @register("question_uptime", f"WITH RECURSIVE {LOG}{N}, {x} SELECT user_id % 3 AS site, count(DISTINCT user_id) AS worn, round(avg(uptime), 2) AS uptime, CAST(sum(outages) AS BIGINT) AS outages, CAST(sum(stuck_minutes) AS BIGINT) AS stuck_minutes FROM d, n WHERE expected > 0 AND day > ts - INTERVAL 60 DAY AND day <= ts GROUP BY 1")
    def uptime(spark, sf_dir):
        return Facts(spark, sf_dir).query(UPTIME)

    @register("measure_device_uptime", f"WITH {x} SELECT c_mktsegment, round(avg(uptime), 6) AS device_uptime FROM d JOIN customer ON user_id = c_custkey WHERE expected > 0 GROUP BY 1")
    def measure(spark, sf_dir):
        return Facts(spark, sf_dir).query(question("device_uptime", ["c_mktsegment"], ["worn"], "customers"))


_devices()

STAY = "SELECT c.*, r.site, r.unit, r.risk, r.high, r.score FROM {customers} c LEFT JOIN {log} r ON r.stay = c.c_custkey AND r.day_at = timestamp(:as_of) WHERE c.c_custkey = 5"
_asked("named_stay", STAY, f"SELECT c.*, r.site, r.unit, r.risk, r.high, r.score FROM customer c LEFT JOIN log r ON r.stay = c.c_custkey AND r.day_at = {T} WHERE c.c_custkey = 5")


def _features() -> None:
    """One stay's latest row of features."""
    from tidemark.plans.catalogue import ORACLES, QUERIES

    @register("named_feature_row", f"WITH f AS ({ORACLES['rolling_features']}) SELECT * FROM f WHERE user_id = 5 QUALIFY bucket = max(bucket) OVER ()")
    def feature_row(spark, sf_dir):
        features = QUERIES["rolling_features"](spark, sf_dir)
        text = "SELECT * FROM {features} WHERE user_id = :stay AND bucket = (SELECT max(bucket) FROM {features} WHERE user_id = :stay)"
        return spark.sql(text, args={"stay": 5}, features=features)


_features()
