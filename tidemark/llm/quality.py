"""Quality rules: exact repetition rules, and a calibrated n-gram classifier.

Rules: counts of words, characters, symbols, repeated lines and words in repeated 5-word windows, over the whole text;
equal lines and windows of a text are told by 64-bit hashes. Classifier: logistic regression on hashed word uni- and
bigrams and character trigrams and pentagrams (code points; relative frequencies within each family), fitted on labelled
rows, its logits calibrated by Platt scaling on rows held out of the fit, and applied in Arrow batches against a fixed
probability.

The fit is on all labelled rows but the quarter that calibrates, whose doc_ids' hashes choose it: their texts are written
once, and each of ROUNDS passes adds up the loss and its gradient on the executors. What reaches the driver has the size
of the weights. A row's part of the gradient is a multiple of UNIT, so sums are exact in any order.

Cases: a null or empty text has no words and fails the rules. Very long texts are worked on whole. Without labels of both
classes there is no classifier and the rules decide alone. Several labels of one doc_id count as the lowest. Null labels
are left out. Repeated doc_ids and further columns pass through, but columns of the documents that are named like a
result give way to it. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays, packed
from tidemark.llm.filters import likely
from tidemark.llm.lines import line_offsets
from tidemark.session import discard, ship_package, shuffles_dropped, written

#: Passes over the labelled rows, and tasks that add up their sums.
ROUNDS, PARTS = 15, 16
#: Parts of the gradient are multiples of this; all of them together are 1 at most.
UNIT = 2.0**-50
#: Steps that the solver looks back on, and its first step for weights of relative frequencies.
MEMORY, FIRST_STEP = 8, 1e4
#: Documents are kept from this calibrated probability on.
MIN_QUALITY = 0.5
#: Words of a window that may be repeated.
WINDOW = 5
#: Hashed features of each family.
BUCKETS = 1 << 14
FAMILIES = ("word", "word pair", "3 characters", "5 characters")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*RULES, "base_failed", "quality", "kept")


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks between each two offsets."""
    running = np.concatenate([[0], np.cumsum(marks)])
    return running[offsets[1:]] - running[offsets[:-1]]


def rules(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a slice."""
    n = len(offsets) - 1
    inside = ~arrays.SPACE[data]
    starts, ends, words = arrays.word_spans(data, offsets, arrays.SPACE)
    hashes = arrays.span_hashes(data, starts, ends)
    # lines with a word, without their line ends
    lines, before = line_offsets(data, offsets)
    row = np.repeat(np.arange(n), np.diff(before))
    end = lines[1:] - 1
    end[before[1:] - 1] += 1
    filled = np.flatnonzero(_sums(inside, lines))
    distinct, _ = arrays.distinct_in_rows(row[filled], arrays.span_hashes(data, lines[filled], end[filled]))
    n_dup = np.bincount(row[filled], minlength=n) - np.bincount(distinct, minlength=n)
    # words in windows that their row has more than once
    row = np.repeat(np.arange(n), np.diff(words))
    windows = arrays.joined_hashes(hashes, WINDOW)
    at = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    keys = arrays.mix(windows[at] ^ arrays.mix(row[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(hashes), bool)
    for i in range(WINDOW):
        covered[at[again] + i] = True
    return np.diff(words), _sums(inside & ((data & 0xC0) != 0x80), offsets), _sums(SYMBOL[data], offsets), n_dup, _sums(covered, words)


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The rules' counts of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return tuple(int(x[0]) for x in rules(data, np.array([0, len(data)])))


def rules_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    """Too few words, or too many of them repeated."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its bytes in UTF-8, one after another), and characters before each row."""
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return data.astype(np.uint32), offsets
    starts = np.flatnonzero(lead)
    size = np.diff(starts, append=len(data))
    values = data[starts].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        values[more] = values[more] << np.uint32(8) | data[starts[more] + i]
    return values, np.searchsorted(starts, offsets)


def gram_buckets(data: np.ndarray, offsets: np.ndarray):
    """For each family: the bucket of each gram, and the first and end gram of each row."""
    data = arrays.lowered(data)
    starts, ends, words = arrays.word_spans(data, offsets, arrays.SPACE)
    hashes = arrays.span_hashes(data, starts, ends)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    yield (hashes >> shift).astype(np.int32), words[:-1], words[1:]
    yield (arrays.joined_hashes(hashes, 2) >> shift).astype(np.int32), words[:-1], np.maximum(words[1:] - 1, words[:-1])
    data, offsets = code_points(data, offsets)
    for k, factors in ((3, (7919, 104729, 1299709)), (5, (7919, 104729, 1299709, 15485863, 179424673))):
        n = max(0, len(data) - k + 1)
        sums = np.zeros(n, np.uint32)
        for i, factor in enumerate(factors):
            sums += data[i : i + n] * np.uint32(factor)
        buckets = ((sums * np.uint32(2654435769)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
        yield buckets, np.minimum(offsets[:-1], n), np.minimum(np.maximum(offsets[1:] - k + 1, offsets[:-1]), n)


@dataclass
class Classifier:
    """Weights by family and bucket, bias, and the calibration p = 1 / (1 + exp(-(slope * logit + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The uncalibrated score of each row."""
        return self.scores(gram_buckets(data, offsets), len(offsets) - 1)

    def scores(self, grams, n: int) -> np.ndarray:
        """The same from the grams of n rows."""
        out = np.full(n, self.bias)
        for weights, (buckets, first, end) in zip(self.weights, grams, strict=True):
            running = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
            first, end = np.minimum(first, len(buckets)), np.minimum(end, len(buckets))
            out += (running[end] - running[first]) / np.maximum(end - first, 1)
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, to 9 places."""
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -60, 60))), 9)


def fit(features: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, held: np.ndarray, rounds: int = 150) -> Classifier | None:
    """The classifier for rows in memory: class-weighted logistic regression, Platt scaling on the held-out rows."""
    if len(set(labels[~held])) < 2:
        return None
    size = len(FAMILIES) * BUCKETS
    row, feature, value = np.repeat(np.arange(len(labels)), [len(f) for f in features]), np.concatenate(features), np.concatenate(values)
    y = (labels > 0).astype(float)
    weight = np.where(held, 0, np.where(y > 0, 0.5 / y[~held].sum(), 0.5 / (1 - y[~held]).sum()))

    def logits(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[feature] * value, len(y)) + x[-1]

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = logits(x)
        error = weight * (_sigmoid(z) - y)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum()), np.append(np.bincount(feature, error[row] * value, size), error.sum())

    x = minimise(objective, size + 1, rounds)
    out = Classifier(x[:-1].reshape(len(FAMILIES), BUCKETS).astype(np.float32), float(x[-1]))
    z, y = logits(x)[held], y[held]

    def sums(slope: float, shift: float, bad: float, good: float) -> tuple[float, ...]:
        p, target = _sigmoid(slope * z + shift), np.where(y > 0, good, bad)
        h = np.maximum(p * (1 - p), 1e-9)
        return (h * z * z).sum(), (h * z).sum(), h.sum(), ((p - target) * z).sum(), (p - target).sum()

    out.slope, out.shift = platt(sums, int(len(y) - y.sum()), int(y.sum()))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def minimise(objective, size: int, rounds: int) -> np.ndarray:
    """L-BFGS from 0 for the loss and gradient that `objective` gives, which is asked `rounds` times at most; the last
    place is a bias, the others are held near 0."""

    def ask(x):
        loss, gradient = objective(x)
        return loss + 5e-7 * (x[:-1] ** 2).sum(), gradient + 1e-6 * np.append(x[:-1], 0)

    x, steps, asked = np.zeros(size), [], 1
    first = np.append(np.full(size - 1, FIRST_STEP), 1.0)
    loss, gradient = ask(x)
    while asked < rounds:
        way, shares = gradient.copy(), []
        for s, d in reversed(steps):
            shares.append((s @ way) / (s @ d))
            way -= shares[-1] * d
        way *= first
        if steps:
            s, d = steps[-1]
            way *= (s @ d) / (d @ (first * d))
        for (s, d), share in zip(steps, reversed(shares), strict=True):
            way += s * (share - (d @ way) / (s @ d))
        slope, length = gradient @ way, 1.0
        if slope < 1e-12:
            break
        while asked < rounds:
            there = x - length * way
            asked += 1
            less, turned = ask(there)
            if less <= loss - 1e-4 * length * slope:
                s, d = there - x, turned - gradient
                if s @ d > 1e-12 * (d @ d):
                    steps = [*steps, (s, d)][-MEMORY:]
                x, loss, gradient = there, less, turned
                break
            length /= 4
    return x


def platt(sums, n_bad: int, n_good: int) -> tuple[float, float]:
    """Slope and shift by Newton's method; `sums` gives the second and first derivatives. (1, 0) without both classes."""
    slope, shift = 1.0, 0.0
    if not n_bad or not n_good:
        return slope, shift
    # Platt's targets keep the slope finite on separable rows
    bad, good = 1 / (n_bad + 2), (n_good + 1) / (n_good + 2)
    for _ in range(50):
        a, b, c, g1, g2 = sums(slope, shift, bad, good)
        step = np.linalg.solve([[a + 1e-6, b], [b, c + 1e-6]], [g1, g2])
        slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-7:
            break
    return slope, shift


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A written table of the labelled rows: good, held, text. Of rows that repeat a doc_id, the first by text stays."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    keys = known.select(F.xxhash64("doc_id").alias("key"))
    rows = likely(documents.select("doc_id", "text").where("doc_id IS NOT NULL"), F.xxhash64("doc_id"), keys, "key")
    rows = rows.join(known, "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 3
    return written(rows.select("good", held.alias("held"), "text"), None, "good boolean, held boolean, text string", "labelled")


def corpus_sums(rows: DataFrame, x: np.ndarray, weights: tuple[float, float]) -> tuple[float, np.ndarray]:
    """Loss and gradient at x over rows (good, text), whose classes weigh so much a row; added up on the executors."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(x)
    edges = np.linspace(0, len(x) + 1, PARTS + 1).astype(int)

    def run(batches):
        x = shared.value
        model = Classifier(x[:-1].reshape(len(FAMILIES), BUCKETS), float(x[-1]))
        out = np.zeros(len(x) + 1)
        for batch in batches:
            for first_row, end_row, data, offsets in arrays.text_slices(batch.column(1)):
                y = batch.column(0).slice(first_row, end_row - first_row).to_numpy(zero_copy_only=False).astype(float)
                grams = list(gram_buckets(data, offsets))
                z = np.round(model.scores(grams, len(y)), 9)
                weight = np.where(y > 0, weights[1], weights[0])
                error = weight * (_sigmoid(z) - y)
                for family, (buckets, first, end) in enumerate(grams):
                    first, end = np.minimum(first, len(buckets)), np.minimum(end, len(buckets))
                    share = np.rint(error / np.maximum(end - first, 1) / UNIT) * UNIT
                    edge = np.bincount(first, share, len(buckets) + 1) - np.bincount(end, share, len(buckets) + 1)
                    out[family * BUCKETS : (family + 1) * BUCKETS] += np.bincount(buckets, np.cumsum(edge)[:-1], BUCKETS)
                out[-2] += (np.rint(error / UNIT) * UNIT).sum()
                out[-1] += (np.rint(weight * (np.logaddexp(0, z) - y * z) / UNIT) * UNIT).sum()
        sums = [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(PARTS), pa.int32()), "sum": pa.array(sums, pa.binary())})

    def add(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out[bucket] = out.get(bucket, 0.0) + np.frombuffer(part)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(out), pa.int32()), "sum": pa.array([v.tobytes() for v in out.values()], pa.binary())})

    schema, total = "bucket int, sum binary", np.zeros(len(x) + 1)
    with shuffles_dropped(spark):
        sums = packed.dealt(rows.mapInArrow(arrays.tidied(run), schema), PARTS).mapInArrow(arrays.tidied(add), schema).toArrow()
    for bucket, part in zip(sums["bucket"].to_pylist(), sums["sum"].to_pylist(), strict=True):
        total[edges[bucket] : edges[bucket + 1]] = np.frombuffer(part)
    shared.destroy()
    return float(total[-1]), total[:-1]


def held_out(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """A written table of rows (good, text): good, and the logit as z."""
    shared = rows.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in arrays.text_slices(batch.column(1)):
                z = np.round(shared.value.logits(data, offsets), 9)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(z, pa.float64())], ["good", "z"])

    return written(rows, arrays.tidied(run), "good boolean, z double", "held-out")


def train(documents: DataFrame, labels: DataFrame) -> Classifier | None:
    """Fits on all labelled rows but a quarter, which calibrates; None without both classes."""
    ship_package(documents.sparkSession)
    table = labelled(documents, labels)
    counts = {(r.held, r.good): r["count"] for r in table.groupBy("held", "good").count().collect()}
    out = None
    if (False, False) in counts and (False, True) in counts:
        weights = 0.5 / counts[False, False], 0.5 / counts[False, True]
        rows = table.where("NOT held").select("good", "text")
        x = minimise(lambda x: corpus_sums(rows, x, weights), len(FAMILIES) * BUCKETS + 1, ROUNDS)
        out = Classifier(x[:-1].reshape(len(FAMILIES), BUCKETS).astype(np.float32), float(x[-1]))
        scored = held_out(table.where("held").select("good", "text"), out)

        def sums(slope: float, shift: float, bad: float, good: float) -> tuple[float, ...]:
            z, logit = F.col("z"), F.col("z") * slope + shift
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))
            h, g = F.greatest(p * (1 - p), F.lit(1e-9)), p - F.when(F.col("good"), good).otherwise(bad)
            return tuple(scored.agg(F.sum(h * z * z), F.sum(h * z), F.sum(h), F.sum(g * z), F.sum(g)).first())

        out.slope, out.shift = platt(sums, counts.get((True, False), 0), counts.get((True, True), 0))
        discard(scored)
    discard(table)
    return out


def judge(documents: DataFrame, classifier: Classifier | None, min_quality: float = MIN_QUALITY) -> DataFrame:
    """All columns of the documents, the rule counts, base_failed, quality (probability or null) and kept; no shuffle."""
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(classifier)
    own = [c for c in documents.columns if c not in RESULTS]
    documents = documents.select(*[F.col(f"`{c}`") for c in own])
    at = own.index("text")
    kinds = [*[T.LongType()] * len(RULES), T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*documents.schema, *map(T.StructField, RESULTS, kinds)])

    def run(batches):
        model = shared.value
        for whole in batches:
            for first, end, data, offsets in arrays.text_slices(whole.column(at)):
                counts = rules(data, offsets)
                failed = rules_failed(counts[0], counts[4])
                quality = None if model is None else model.probabilities(model.logits(data, offsets))
                kept = ~failed if model is None else ~failed & (quality >= min_quality)
                scores = pa.nulls(len(failed), pa.float64()) if quality is None else pa.array(quality, pa.float64())
                columns = [*whole.slice(first, end - first).columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), scores, pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, [*own, *RESULTS])

    return documents.mapInArrow(arrays.tidied(run), schema)
