"""SQL from outside: checked on Spark's own syntax tree, then run with a row cap and a time limit."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, Row, SparkSession

MAX_ROWS = 200
#: Functions that reach outside the query's data.
DENIED = re.compile(r"^(java_method|reflect|try_reflect|input_file_\w+|current_database|current_schema|current_catalog|current_user|user|session_user|version|raise_error|sleep|read_files|spark_partition_id|from_avro|assert_true)$")
#: Plan nodes of which a query may consist; any other ends the check.
PLAIN = {
    "Project", "Filter", "UnresolvedHaving", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except",
    "Join", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "OneRowRelation", "WithWindowDefinition", "UnresolvedInlineTable",
    "LocalRelation", "Generate", "LateralJoin", "Pivot", "Unpivot", "Sample",
}


class Refused(ValueError):
    """A text that is not run, and why."""


def _children(node) -> list:
    found = []
    for name in ("children", "innerChildren", "expressions"):
        try:
            seq = getattr(node, name)()
        except Exception:  # not every kind of node has all three
            continue
        found += [seq.apply(i) for i in range(seq.size())]
    return found


def _inner_plans(node) -> list:
    """Plans inside a subquery expression or a WITH clause."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        relations = node.cteRelations()
        return [relations.apply(i)._2() for i in range(relations.size())]
    if kind in {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery"} and hasattr(node, "plan"):
        try:
            return [node.plan()]
        except Exception:
            return []
    return []


def _parsed(spark: SparkSession, text: str):
    """Spark's syntax tree of one statement."""
    if not text:
        raise Refused("there is nothing to run")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused(f"this does not parse: {str(e).splitlines()[0][:200]}") from None


def vet(spark: SparkSession, text: str, tables: Collection[str], schema: str | None = None) -> str:
    """The text without its end mark, if it is one plain query over these tables; otherwise Refused is raised."""
    text = text.strip().removesuffix(";").rstrip()
    root = _parsed(spark, text)
    known = {t.lower() for t in tables}
    known |= {f"{schema}.{t}".lower() for t in known} if schema else set()
    nodes, todo, ctes = [], [root], set()
    while todo:
        node = todo.pop()
        nodes.append(node)
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            ctes |= {relations.apply(i)._1().lower() for i in range(relations.size())}
        todo += _children(node) + _inner_plans(node)
    logical = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            table = ".".join(parts.apply(i) for i in range(parts.size())).lower()
            if table not in known and not (parts.size() == 1 and table in ctes):
                raise Refused(f"no table {table} here")
        elif kind == "UnresolvedFunction":
            parts = node.nameParts()
            name = parts.apply(parts.size() - 1).lower()
            if parts.size() > 1 or DENIED.match(name):
                raise Refused(f"{name}() can't be called here")
        elif logical.isInstance(node) and kind not in PLAIN:
            raise Refused(f"{kind} is no part of a plain query")
    return text


def answer(spark: SparkSession, text: str, tables: Collection[str], schema: str | None = None, seconds: float = 5.0) -> list[Row]:
    """The first MAX_ROWS rows of a query that was vetted; its jobs are cancelled when the time is over."""
    frame: DataFrame = spark.sql(vet(spark, text, tables, schema)).limit(MAX_ROWS)
    tag = f"guarded-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop():
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return frame.collect()
    except Exception as e:
        raise TimeoutError(f"no answer within {seconds} s") from e if late.is_set() else e
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
