"""Risk models: splits, features, fitting with pyspark.ml, calibration, explanation and what-if changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bands

#: Fixed value: how much the raw score breaks ties of the calibrated one.
TIE_BREAK = 1e-6


def feature_columns(frame: DataFrame, without: Sequence[str]) -> list[str]:
    """All columns but ids, times, labels and text states."""
    return [f.name for f in frame.schema if f.name not in set(without) and f.dataType.typeName() in {"double", "float", "integer", "long", "boolean", "short", "decimal"}]


def one_hot(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column for each value, named column=value."""
    return frame.withColumns({f"{column}={v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values}).drop(column)


def time_split(frame: DataFrame, ts: str, train_days: int, valid_days: int, gap_hours: int = 6) -> DataFrame:
    """Adds `part`: train, valid or test by days from the first one; the hours before a boundary belong to none, since
    their labels look across it."""
    start = frame.agg(F.date_trunc("day", F.min(ts)).alias("_start"))
    rows = frame.crossJoin(F.broadcast(start))  # one row
    first = F.col("_start") + F.expr(f"INTERVAL {train_days} DAYS")
    second = F.col("_start") + F.expr(f"INTERVAL {train_days + valid_days} DAYS")
    gap, t = F.expr(f"INTERVAL {gap_hours} HOURS"), F.col(ts).cast("timestamp")
    part = F.when(t < first - gap, "train").when((t >= first) & (t < second - gap), "valid").when(t >= second, "test")
    return rows.withColumn("part", part).where("part IS NOT NULL").drop("_start")


def recent_split(frame: DataFrame, ts: str, valid_days: int, test_days: int) -> DataFrame:
    """Adds `part`, counted back from the last time: edges belong to the earlier part."""
    end = frame.agg(F.max(F.col(ts).cast("timestamp")).alias("_end"))
    rows, t = frame.crossJoin(F.broadcast(end)), F.col(ts).cast("timestamp")  # one row
    test = F.col("_end") - F.expr(f"INTERVAL {test_days} DAYS")
    valid = F.col("_end") - F.expr(f"INTERVAL {test_days + valid_days} DAYS")
    return rows.withColumn("part", F.when(t > test, "test").when(t > valid, "valid").otherwise("train")).drop("_end")


def fit_linear(train: DataFrame, features: Sequence[str], label: str, strength: float = 0.1) -> PipelineModel:
    """Medians for what is missing, unit scales, L2 logistic regression."""
    filled = [f"{f}_filled" for f in features]
    n = max(1, train.count())
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_features", labelCol=label, regParam=1 / (strength * n), probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_margin"),
    ]
    return Pipeline(stages=stages).fit(train)


def fit_trees(train: DataFrame, features: Sequence[str], label: str, rounds: int = 30, seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees on medians for what is missing."""
    filled = [f"{f}_filled" for f in features]
    trees = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=4, seed=seed, predictionCol="_prediction")
    trees = trees.setRawPredictionCol("_margin").setProbabilityCol("_probability")
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_features"), trees]
    return Pipeline(stages=stages).fit(train)


def raw_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with `raw`, the model's probability of 1."""
    return model.transform(rows).withColumn("raw", vector_to_array("_probability")[1]).select(*rows.columns, "raw")


def fit_calibration(scored: DataFrame, label: str) -> IsotonicRegressionModel:
    """Isotonic regression with two anchors: a negative at the largest score and a positive at the smallest, so that
    no probability is 0 or 1."""
    ends = scored.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    anchors = ends.select(F.col("hi").alias("raw"), F.lit(0.0).alias(label)).unionByName(ends.select(F.col("lo").alias("raw"), F.lit(1.0).alias(label)))
    rows = scored.select("raw", F.col(label).cast("double").alias(label)).unionByName(anchors)
    return IsotonicRegression(featuresCol="raw", labelCol=label, predictionCol="calibrated").fit(rows)


def calibrated(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    """Adds `risk`: the calibrated probability, ties in the order of the raw score."""
    rows = model.transform(scored)
    return rows.withColumn("risk", F.least(F.lit(1.0), F.col("calibrated") + TIE_BREAK * F.col("raw"))).drop("calibrated")


def contributions(coefficients: Mapping[str, float], means: Mapping[str, float], scales: Mapping[str, float]) -> Column:
    """Array of (feature, value): what each feature adds to the logit beside its background mean."""
    parts = [F.struct(F.lit(n).alias("feature"), (c * (F.coalesce(F.col(n).cast("double"), F.lit(means[n])) - means[n]) / scales[n]).alias("value")) for n, c in coefficients.items()]
    return F.array(*parts)


def top_factors(parts: Column, groups: Mapping[str, str], k: int = 3) -> Column:
    """JSON of the k groups with the largest sums by size; a group is the first prefix that fits, named by its text,
    and its driver the feature that adds most."""
    group = F.lit("other")
    label = lambda f: group_of(f, groups, group)
    named = F.transform(parts, lambda p: F.struct(label(p["feature"]).alias("group"), p["feature"].alias("feature"), p["value"].alias("value")))
    keys = F.array_distinct(F.transform(named, lambda p: p["group"]))

    def summed(key):
        own = F.filter(named, lambda p: p["group"] == key)
        total = F.aggregate(own, F.lit(0.0), lambda s, p: s + p["value"])
        driver = F.element_at(F.array_sort(F.transform(own, lambda p: F.struct((-F.abs(p["value"])).alias("size"), p["feature"].alias("feature")))), 1)["feature"]
        return F.struct((-F.abs(total)).alias("size"), key.alias("group"), driver.alias("driver"), F.round(total, 6).alias("value"))

    best = F.slice(F.array_sort(F.transform(keys, summed)), 1, k)
    return F.to_json(F.transform(best, lambda b: F.struct(b["group"].alias("group"), b["driver"].alias("driver"), b["value"].alias("value"))))


def group_of(feature: Column, groups: Mapping[str, str], default: Column) -> Column:
    """Text of the first prefix that the feature's name starts with."""
    out = default
    for prefix, text in reversed(list(groups.items())):
        out = F.when(feature.startswith(prefix), text).otherwise(out)
    return out


#: Levels of alertness, and the first step of oxygen in litres a minute.
ALERTNESS, FIRST_STEP = ("A", "C", "V", "P", "U"), 2.0
SCORED = ("resp_rate", "spo2", "sbp", "heart_rate", "temp_c")


def what_if(row: DataFrame, changes: Mapping[str, object], score: str = "news2") -> DataFrame:
    """The rows as if the last hour had been other: vitals by name, `on_oxygen`, `acvpu`.

    A vital's figures of the hour become the new value, longer means move by their share of the change (or become the
    value, where there were none), the trend by all of it. Oxygen that is taken off flows no more, oxygen that is put on
    flows at the first step. Where the rows have the medians of all scored vitals, the parts of the early-warning score and
    its total (columns <score>_...) are made again. What the rows lack is an error.
    """
    flags = {"on_oxygen", "acvpu"}
    odd = sorted(c for c in changes if c not in flags and f"{c}_mean_1h" not in row.columns)
    if odd:
        raise ValueError(f"no vital {', '.join(odd)}")
    if changes.get("acvpu", "A") not in ALERTNESS:
        raise ValueError(f"acvpu is one of {', '.join(ALERTNESS)}")
    new: dict[str, Column] = {}
    for vital, value in changes.items():
        if vital in flags:
            continue
        value, old = F.lit(float(value)), F.col(f"{vital}_mean_1h")
        change = F.coalesce(value - old, F.lit(0.0))
        new |= {f"{vital}_{s}_1h": value for s in ("mean", "median", "min", "max")}
        new |= {f"{vital}_mean_{h}h": F.coalesce(F.col(f"{vital}_mean_{h}h") + change / h, value) for h in (3, 6)}
        new[f"{vital}_trend_3h"] = F.col(f"{vital}_trend_3h") + change
    if "on_oxygen" in changes:
        on = bool(changes["on_oxygen"])
        flow = F.coalesce("o2_flow_lpm", F.lit(0.0))
        new |= {"on_oxygen": F.lit(on), "o2_flow_lpm": F.when(flow == 0, FIRST_STEP).otherwise(flow) if on else F.lit(0.0)}
    if "acvpu" in changes:
        new |= {"acvpu": F.lit(changes["acvpu"]), "new_confusion": F.lit(changes["acvpu"] != "A")}
    out = row.withColumns({n: c for n, c in new.items() if n in row.columns})
    if all(f"{v}_median_1h" in row.columns for v in SCORED):
        has = lambda name, other: F.col(name) if name in out.columns else F.lit(other)
        parts = bands.early_warning(**{v: F.col(f"{v}_median_1h") for v in SCORED}, on_oxygen=has("on_oxygen", False), alertness=has("acvpu", "A"), scale_2=has("copd", False))
        out = out.withColumns({f"{score}_{n}": c for n, c in parts.items()})
    return out


def unscored(grid: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the grid that the log does not have: each is scored once."""
    return grid.join(log, list(keys), "left_anti")
