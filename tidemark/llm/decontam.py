"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower-cased runs of letters, digits and code points from \\x80 on) are reduced to the benchmark's vocabulary.
   All passages of the corpus (two neighbouring chunks of CHUNK words) are written as terms, for all items in one pass,
   and their occurrences counted.
2. A randomised SVD of all these TF-IDF passages, with the benchmark's own, gives RANK directions: each round multiplies
   the passages' matrix and its transpose with a thin matrix, task by task, and adds the products, on the executors, in
   PARTS parts. Together, the benchmark's passages weigh as much as the corpus', so directions for them stay as it grows.
3. Every passage of every document is projected and compared with the benchmark's by cosine. A candidate goes on if it
   holds COVERED of the item's term weights.
4. It is confirmed by the longest common subsequence of the item with the words around the passage, in a
   window of 1.5 times the item's length: at least STRONG of its words, or at least WEAK of them if the answer (the
   item's last sentence, but a third of its words at most) is there too. So paraphrases that keep most words in
   order are found, while a few borrowed words are not.

The benchmark is the stated query set: its items are taken in blocks of ITEMS items and BLOCK_WORDS words at most, each
searched against all documents with directions of its own. Tests hold the result against steps 3 and 4 done without
retrieval (every window of every document with every item).

Cases: a null or empty text, of a document or an item, matches nothing. Items with the same text match alike; items
without item_id are searched like the others and found under a null one. An item of more than SECTION words is taken in
sections of about as many words, and a document that holds one of them holds the item. Rows that repeat a doc_id or
item_id give the best of their matches. Items whose words are all very common keep them as terms. Other columns are
ignored. An empty benchmark or corpus gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays, packed
from tidemark.session import discard, ship_package, shuffles_dropped, written

CHUNK = 24
RANK = 128
#: Passages of the corpus that one of the benchmark's weighs as much as, at least.
OWN = 4.0
#: Parts that thin matrices are added up in, and terms in a row of the written passages.
PARTS, ROW = 16, 1 << 16
PASSAGES = "terms binary, counts binary, chunks long"
#: A block of items, and the words from which an item is cut in sections.
ITEMS, BLOCK_WORDS, SECTION = 500, 16_000, 400
#: Cosine from which a passage is a candidate, and the share of an item's term weights that it must hold.
MIN_COSINE, COVERED = 0.2, 0.3
STRONG, WEAK, ANSWER = 0.8, 0.6, 0.5
#: Words that occur more often than in this share of all chunks are no terms.
MAX_SHARE = 0.01
FOUND = "doc_id long, item_id long, lcs_share double, answer_share double, first_word long, end_word long"
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


@dataclass
class Item:
    """A benchmark item: its words as terms, and where its answer begins among them."""

    item_id: int
    words: np.ndarray
    answer: int


class Vocabulary:
    """Sorted hashes of the words of some items."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.table = hashes, None

    def __getstate__(self):
        return {"hashes": self.hashes, "table": None}

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Term of each hash, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        if self.table is None:
            # a table by leading bits, wide enough that no two terms share a place, or else a search
            self.table = np.zeros(0, np.int32)
            for bits in range(16, 23):
                slot = (self.hashes >> np.uint64(64 - bits)).astype(np.int64)
                if (np.diff(slot) > 0).all():
                    self.table = np.full(1 << bits, -1, np.int32)
                    self.table[slot] = np.arange(len(slot))
                    break
        if len(self.table):
            at = self.table[(hashes >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)]
        else:
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1).astype(np.int32)
        return np.where((at >= 0) & (self.hashes[at] == hashes), at, np.int32(-1))

    def terms(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term of each word, -1 for others; words before each row."""
        starts, ends, words = arrays.word_spans(data, offsets, arrays.NOT_ALNUM)
        return self.places(arrays.span_hashes(data, starts, ends)), words


def _text_column(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def answer_start(text: str) -> int:
    """Index of the word at which the answer begins: the last sentence, at most a third of the words, at least three."""
    n = len(_WORD.findall(text.lower()))
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if _WORD.search(s.lower())]
    last = len(_WORD.findall(sentences[-1].lower())) if sentences else 0
    return max(0, n - max(3, min(last, n // 3)))


def make_items(rows: list[tuple[int | None, str]]) -> tuple[Vocabulary, list[Item]]:
    """Vocabulary and items of a block; long items in sections."""
    column = _text_column(pa.array([t for _, t in rows], pa.string()))
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in arrays.text_slices(column):
        starts, ends, words = arrays.word_spans(data, offsets, arrays.NOT_ALNUM)
        hashes.append(arrays.span_hashes(data, starts, ends))
        counts.append(np.diff(words))
    every = np.concatenate(hashes)
    vocabulary = Vocabulary(np.unique(every))
    parts = np.split(vocabulary.places(every), np.cumsum(np.concatenate(counts))[:-1]) if rows else []
    items = []
    for (item_id, text), words in zip(rows, parts, strict=True):
        if len(words) > SECTION:
            cuts = np.linspace(0, len(words), -(-len(words) // SECTION) + 1).astype(int).tolist()
            items += [Item(item_id, words[a:b], (b - a) * 2 // 3) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        elif len(words):
            items.append(Item(item_id, words, answer_start(text)))
    return vocabulary, items


def chunk_of_words(words: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Chunk of each word, and chunks before each row, given the words before each row."""
    counts = np.diff(words)
    before = np.concatenate([[0], np.cumsum(-(-counts // size))])
    return np.repeat(before[:-1], counts) + (np.arange(words[-1]) - np.repeat(words[:-1], counts)) // size, before


def corpus_passages(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All passages of all documents as a written table (PASSAGES): the terms of many passages in a row, how many each
    passage has, and the chunks that they come from."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in arrays.text_slices(_text_column(batch.column(0))):
                terms, words = shared.value.terms(data, offsets)
                passage, _ = chunk_of_words(words, 2 * CHUNK)
                known = terms >= 0
                passage, terms = passage[known], terms[known].astype(np.int32)
                counts = np.diff(np.flatnonzero(np.diff(passage, prepend=-1)), append=len(passage)).astype(np.int32)
                cuts = np.flatnonzero(np.diff((np.cumsum(counts, dtype=np.int64) - 1) // ROW, prepend=-1))
                if not len(cuts):
                    cuts = np.zeros(1, np.int64)
                ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                edges = np.append(cuts, len(counts))
                chunks = np.zeros(len(cuts), np.int64)
                chunks[0] = (-(-np.diff(words) // CHUNK)).sum()
                columns = [packed.binary(terms, np.diff(ends[edges])), packed.binary(counts, np.diff(edges)), pa.array(chunks)]
                yield pa.RecordBatch.from_arrays(columns, ["terms", "counts", "chunks"])

    return written(documents.select("text"), arrays.tidied(run), PASSAGES, "passages")


def frequencies(passages: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Occurrences of each of n terms in the corpus, and its chunks in all; summed before anything leaves the executors."""

    def run(batches):
        seen = np.zeros(n + 1, np.int64)
        for batch in batches:
            np.add.at(seen, packed.joined(batch.column(0), np.int32), 1)
            seen[n] += pc.sum(batch.column(2)).as_py() or 0
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "n": pa.array(seen[some], pa.int64())})

    rows = passages.mapInArrow(arrays.tidied(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n + 1, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out[:n], int(out[n])


def term_weights(items: list[Item], frequency: np.ndarray, chunks: int) -> np.ndarray:
    """Inverse document frequencies; 0 for words that are too common, unless an item would keep under 3 terms."""
    weights = np.log((1 + chunks) / (1 + frequency)).astype(np.float32) + 1
    common = frequency > max(MAX_SHARE * chunks, 20)
    for item in items:
        own = np.unique(item.words)
        if (~common[own]).sum() < 3:
            common[own[np.argsort(frequency[own], kind="stable")[:3]]] = False
    return np.where(common, np.float32(0), weights)


def item_passages(item: Item) -> list[np.ndarray]:
    """An item's words in windows as long as a document's passages."""
    n, size = len(item.words), 2 * CHUNK
    starts = {min(i, n - size) for i in range(0, n - CHUNK, CHUNK)} if n > size else {0}
    return [item.words[i : i + size] for i in sorted(starts)]


def product(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """A^T A thin for passages of `counts` terms each, rows of unit length."""
    row, value = np.repeat(np.arange(len(counts)), counts), weights[terms]
    norm = np.sqrt(np.maximum(np.bincount(row, value**2, len(counts)), 1e-12)).astype(np.float32)
    value = (value / norm[row])[:, None]
    projected = run_sums(thin, terms, np.cumsum(counts) - counts, counts, value)
    order = np.argsort(terms, kind="stable")
    first = np.flatnonzero(np.diff(terms[order], prepend=-1))
    out = np.zeros_like(thin)
    out[terms[order[first]]] = run_sums(projected, row[order], first, np.diff(first, append=len(terms)), value[order])
    return out


def fit_directions(
    passages: DataFrame, chunks: int, places: np.ndarray, items: list[Item], weights: np.ndarray, rank: int = RANK, rounds: int = 3
) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages, by subspace iteration from a random start.

    `passages` are those of the whole corpus of so many chunks, `places` has the block's term for each of theirs. A
    round's product with the matrix and its transpose is a sum over tasks of thin matrices, terms x rank: each task adds
    up its own and deals them out in parts, a task for a part adds those, and the driver puts the parts together and
    orthonormalises.
    """
    spark = passages.sparkSession
    places = np.where((places >= 0) & (weights[places] > 0), places, np.int32(-1))
    shared = spark.sparkContext.broadcast((places, weights))
    own = [p[weights[p] > 0] for item in items for p in item_passages(item)]
    own = [p for p in own if len(p)]
    own_weight = np.float32(max(OWN, chunks / 2 / max(1, len(own))))
    rank = min(rank, len(weights))
    edges = np.linspace(0, len(weights), PARTS + 1).astype(int)

    def step(thin: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(thin)

        def run(batches):
            place, weight = shared.value
            out = None
            for batch in batches:
                for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    terms, counts = place[np.frombuffer(terms, np.int32)], np.frombuffer(counts, np.int32)
                    use = terms >= 0
                    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[use], minlength=len(counts))
                    if use.any():
                        one = product(terms[use], counts[counts > 0], weight, sent.value)
                        out = one if out is None else out + one
            if out is not None:
                sums = [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(PARTS), pa.int32()), "sum": pa.array(sums, pa.binary())})

        def add(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out[bucket] = out.get(bucket, 0.0) + np.frombuffer(x, np.float32).astype(np.float64)
            sums = pa.array([x.astype(np.float32).tobytes() for x in out.values()], pa.binary())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(out), pa.int32()), "sum": sums})

        total = np.zeros_like(thin)
        if own:
            total += own_weight * product(np.concatenate(own), np.array([len(p) for p in own]), weights, thin)
        schema = "bucket int, sum binary"
        with shuffles_dropped(spark):
            sums = packed.dealt(passages.mapInArrow(arrays.tidied(run), schema), PARTS).mapInArrow(arrays.tidied(add), schema).toArrow()
        for bucket, x in zip(sums["bucket"].to_pylist(), sums["sum"].to_pylist(), strict=True):
            total[edges[bucket] : edges[bucket + 1]] += np.frombuffer(x, np.float32).reshape(-1, thin.shape[1])
        sent.unpersist()
        return total

    thin = np.linalg.qr(np.random.default_rng(5).standard_normal((len(weights), rank)))[0].astype(np.float32)
    for _ in range(rounds):
        thin = np.linalg.qr(step(thin))[0].astype(np.float32)
    return thin


def run_sums(rows: np.ndarray, which: np.ndarray, starts: np.ndarray, counts: np.ndarray, factors: np.ndarray | None = None) -> np.ndarray:
    """The sum over each run (of at least one) of the rows that `which` names, times their factors.

    All runs add their first row, then those that have a second, and so on: a few passes over short runs.
    """
    order = np.argsort(-counts, kind="stable")
    starts, left = starts[order], -counts[order]
    out = np.zeros((len(order), rows.shape[1]), rows.dtype)
    for j in range(int(-left[0]) if len(left) else 0):
        at = starts[: np.searchsorted(left, -j)] + j
        part = rows[which[at]]
        out[: len(at)] += part if factors is None else part * factors[at]
    back = np.empty_like(out)
    back[order] = out
    return back


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with the n words whose places `masks` holds (bit-parallel)."""
    full = (1 << n) - 1
    state = full
    for w in words:
        if m := masks.get(w):
            hit = state & m
            state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def _masks(words) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Searcher:
    """Projects passages, finds candidates by cosine, and confirms them."""

    def __init__(self, vocabulary: Vocabulary, items: list[Item], weights: np.ndarray, directions: np.ndarray, min_cosine: float = MIN_COSINE):
        self.vocabulary, self.items, self.weights, self.min_cosine = vocabulary, items, weights, min_cosine
        self.basis = (weights[:, None] * directions).astype(np.float32)
        passages = [(i, p) for i, item in enumerate(items) for p in item_passages(item)]
        self.item_of = np.array([i for i, _ in passages])
        queries = np.array([self.basis[p].sum(0) for _, p in passages], np.float32)
        self.queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
        self.shares = np.zeros((len(passages), len(weights)), np.float32)
        for i, (_, p) in enumerate(passages):
            own = np.unique(p)
            self.shares[i, own] = weights[own] / max(weights[own].sum(), 1e-9)
        self.whole = [_masks(item.words.tolist()) for item in items]
        self.ends = [_masks(item.words[item.answer :].tolist()) for item in items]

    def candidates(self, data: np.ndarray, offsets: np.ndarray):
        """Terms, words before each row, and (row, chunk in the row, item) of each candidate."""
        terms, words = self.vocabulary.terms(data, offsets)
        chunks, before = chunk_of_words(words)
        use = terms >= 0
        use[use] = self.weights[terms[use]] > 0
        used, at = terms[use], chunks[use]
        found = np.flatnonzero(np.diff(at, prepend=-1))
        latent = np.zeros((before[-1], self.basis.shape[1]), np.float32)
        seen = np.zeros(before[-1], np.int64)
        if len(found):
            seen[at[found]] = np.diff(found, append=len(at))
            latent[at[found]] = run_sums(self.basis, used, found, seen[at[found]])
        row_of = np.repeat(np.arange(len(words) - 1), np.diff(before))
        follows = np.zeros(len(row_of), bool)
        follows[:-1] = row_of[1:] == row_of[:-1]
        joint, number = latent.copy(), seen.copy()
        joint[:-1][follows[:-1]] += latent[1:][follows[:-1]]
        number[:-1][follows[:-1]] += seen[1:][follows[:-1]]
        alone = ~follows
        alone[1:] &= ~follows[:-1]
        some = np.flatnonzero((number >= 2) & (follows | alone))
        sims = joint[some] @ self.queries.T
        sims /= np.maximum(np.linalg.norm(joint[some], axis=1, keepdims=True), 1e-9)
        p, q = np.nonzero(sims >= self.min_cosine)
        place = some[p]
        first = np.searchsorted(at, place)
        count = np.searchsorted(at, place + 1 + follows[place]) - first
        each = np.repeat(np.arange(len(place)), count)
        tokens = used[np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        enough = np.bincount(each, self.shares[q[each], tokens], len(place)) >= COVERED
        place, q = place[enough], q[enough]
        return terms, words, row_of[place], place - before[row_of[place]], self.item_of[q]

    def confirm(self, terms: np.ndarray, item: int, first: int, end: int) -> tuple[float, float, int, int] | None:
        """LCS share, answer share and window of the best window within terms[first:end], if it confirms the item."""
        n = len(self.items[item].words)
        need = math.ceil(WEAK * n)
        region = terms[first:end]
        places = np.flatnonzero(region >= 0)
        region = region[places]
        if len(region) < need or common_subsequence(self.whole[item], n, known := region.tolist()) < need:
            return None
        best, size, step = None, math.ceil(1.5 * n), max(1, n // 4)
        for start in range(0, max(1, end - first - size + step), step):
            a, b = np.searchsorted(places, [start, start + size])
            length = common_subsequence(self.whole[item], n, known[a:b])
            if length >= need and (best is None or length / n > best[0]):
                inside = [i for i in range(a, b) if known[i] in self.whole[item]]
                tail = n - self.items[item].answer
                answer = common_subsequence(self.ends[item], tail, known[a:b]) / tail
                best = (length / n, answer, first + int(places[inside[0]]), first + int(places[inside[-1]]) + 1)
        if best and (best[0] >= STRONG or best[1] >= ANSWER):
            return best
        return None

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, item, LCS share, answer share, first word, end word) of each row's confirmed items, the best of each."""
        terms, words, rows, chunks, items = self.candidates(data, offsets)
        best: dict[tuple[int, int], tuple] = {}
        for row, chunk, item in sorted(set(zip(rows.tolist(), chunks.tolist(), items.tolist(), strict=True))):
            n = len(self.items[item].words)
            first = max(words[row], words[row] + chunk * CHUNK - n)
            end = min(words[row + 1], words[row] + (chunk + 2) * CHUNK + n)
            found = self.confirm(terms, item, first, end)
            if found and ((row, item) not in best or found[0] > best[row, item][0]):
                best[row, item] = (*found[:2], found[2] - words[row], found[3] - words[row])
        return [(*key, *value) for key, value in best.items()]


def item_blocks(benchmark: DataFrame, size: int = ITEMS):
    """Blocks of (item_id, text), without items of no words. A block closes at `size` items or BLOCK_WORDS words."""
    block: list[tuple[int | None, str]] = []
    words = 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if r.text and (n := len(_WORD.findall(r.text.lower()))):
            block.append((r.item_id, r.text))
            words += n
        if len(block) == size or words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def searchers(documents: DataFrame, benchmark: DataFrame) -> list[Searcher]:
    """One for each block of items: the corpus is made into passages and counted once for all of them."""
    ship_package(documents.sparkSession)
    blocks = [make_items(rows) for rows in item_blocks(benchmark)]
    if not blocks:
        return []
    every = Vocabulary(np.unique(np.concatenate([v.hashes for v, _ in blocks])))
    passages, out = corpus_passages(documents, every), []
    counts, chunks = frequencies(passages, len(every.hashes))
    for vocabulary, items in blocks:
        weights = term_weights(items, counts[every.places(vocabulary.hashes)], chunks)
        out.append(Searcher(vocabulary, items, weights, fit_directions(passages, chunks, vocabulary.places(every.hashes), items, weights)))
    discard(passages)
    return out


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it contains (FOUND); nothing is shuffled but the matches."""
    out = None
    for searcher in searchers(documents, benchmark):
        part = _search(documents, searcher)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], T._parse_datatype_string(FOUND))
    best = F.max(F.struct("lcs_share", "answer_share", (-F.col("first_word")).alias("at"), "end_word")).alias("best")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "best.lcs_share", "best.answer_share", (-F.col("best.at")).alias("first_word"), "best.end_word")


def _search(documents: DataFrame, searcher: Searcher) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(searcher)

    def run(batches):
        for batch in batches:
            for first, _, data, offsets in arrays.text_slices(_text_column(batch.column(1))):
                hits = shared.value.search(data, offsets)
                if hits:
                    row, item, *rest = zip(*hits, strict=True)
                    ids = batch.column(0).take(pa.array([first + r for r in row]))
                    items = pa.array([shared.value.items[i].item_id for i in item], pa.int64())
                    shares = [pa.array([round(float(x), 6) for x in c], pa.float64()) for c in rest[:2]]
                    places = [pa.array([int(x) for x in c], pa.int64()) for c in rest[2:]]
                    yield pa.RecordBatch.from_arrays([ids, items, *shares, *places], ["doc_id", "item_id", "lcs_share", "answer_share", "first_word", "end_word"])

    return documents.select("doc_id", "text").mapInArrow(arrays.tidied(run), FOUND)


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns. Judged row by row, whatever the doc_id; no shuffle."""
    at = documents.columns.index("text")
    for searcher in searchers(documents, benchmark):
        documents = documents.mapInArrow(arrays.tidied(_cleaner(documents.sparkSession.sparkContext.broadcast(searcher), at)), documents.schema)
    return documents


def _cleaner(shared, at: int):
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in arrays.text_slices(_text_column(batch.column(at))):
                clean = np.ones(end - first, bool)
                clean[[row for row, *_ in shared.value.search(data, offsets)]] = False
                yield batch.slice(first, end - first).filter(pa.array(clean))

    return run
