"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words split at ASCII white space; with fewer
words the whole sequence is the one shingle). A register keeps, for the smallest hash of its bucket, the count of
leading zeros and the bits that follow the first one. A document has 128 coarse registers (10 such bits, 16 in all),
which are banded, and 512 fine ones (4 such bits, 8 in all), which estimate. Equal sets are one class from the start
(128-bit hashes), and classes are what is compared. Bands of 4 coarse registers make candidates:

1. In each band bucket every class is paired with the smallest one; a class in several buckets of more than FEW
   is paired with the smallest of those alone. Pairs whose Jaccard estimate (matching
   registers, corrected for the collisions that two unrelated sets of these sizes would have) is too far below the
   threshold are left out; the others are decided on the full sets.
2. Components of the links so far. In buckets that still hold several components, all classes outside the most
   frequent component (the minor ones) are compared with all others, block by block: pairs of different components
   are estimated in arrays, in the first band they share. For ROUNDS rounds the minor classes try the best of them, so
   that components grow together as in Boruvka's algorithm.
3. The pairs of still different components whose estimate allows a link are all decided, a pair of blocks at a time.

So no bucket's pairs are ever listed, a bucket of copies costs one pair a member, the classes of a bucket's
most frequent component are copied once for each block of the others, and no candidate pair that could join two components is left undecided. At a
similarity of 0.85 two large sets share no band with a probability of (1 - 0.85^4)^32, 6e-11 (at 0.8, 5e-8), and are
estimated too low by MARGIN standard errors with one of 3e-6.

Cases: a document without words links with nothing, its own component. Rows that repeat a doc_id are one node: their
texts' links are the node's, in whatever order rows come. Null doc_ids get no component and are kept. Very long texts
are sets like others; blocks are bounded by shingles too. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays
from tidemark.llm.filters import likely
from tidemark.llm.graph import components
from tidemark.llm.streams import groups, pieces_by_key
from tidemark.session import checkpointed, discard, settle, ship_package, written

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bits of the bucket and of the mantissa.
COARSE, FINE = (7, 10), (9, 4)
BAND = 4
BANDS = (1 << COARSE[0]) // BAND
EMPTY = {COARSE: 0xFFFF, FINE: 0xFF}
#: Standard errors that an estimate may lie below the threshold.
MARGIN = 4.5
#: Classes and shingles of a block when a band bucket is compared, and members verified against one copy of a leader.
BLOCK, SHINGLES, MEMBERS = 1024, 1 << 19, 64
#: Members of a bucket in which every one is paired with the smallest.
FEW = 8
#: Rounds of best pairs before all pairs that are left.
ROUNDS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, shingle hash) pairs of a slice, sorted."""
    data = arrays.lowered(data)
    starts, ends, words = arrays.word_spans(data, offsets, arrays.SPACE)
    hashes = arrays.span_hashes(data, starts, ends)
    counts = np.diff(words)
    row_of = np.repeat(np.arange(len(counts)), counts)
    whole = arrays.joined_hashes(hashes, WORDS)
    inside = row_of[: len(whole)] == row_of[WORDS - 1 :] if len(whole) else np.zeros(0, bool)
    rows, values = [row_of[: len(whole)][inside]], [whole[inside]]
    for n in range(1, WORDS):
        short = np.flatnonzero(counts == n)
        if len(short):
            value = hashes[words[short]] + np.uint64(n)
            for i in range(1, n):
                value = arrays.mix(value * np.uint64(0x2545F4914F6CDD1D) + hashes[words[short] + i])
            rows.append(short)
            values.append(arrays.mix(value + np.uint64(n)))
    return arrays.distinct_in_rows(np.concatenate(rows), np.concatenate(values))


def registers(rows: np.ndarray, values: np.ndarray, n_rows: int, kind: tuple[int, int]) -> np.ndarray:
    """A register for each bucket of each row: leading zeros and mantissa of its smallest hash, or EMPTY."""
    bucket_bits, mantissa_bits = kind
    empty = EMPTY[kind]
    out = np.full((n_rows, 1 << bucket_bits), empty, np.uint16 if empty > 255 else np.uint8)
    bucket = (values >> np.uint64(64 - bucket_bits)).astype(np.int64)
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (bucket[1:] != bucket[:-1])
    least = values[first] << np.uint64(bucket_bits)
    exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.minimum(53 - exponent, (empty >> mantissa_bits) - 1).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - mantissa_bits)
    out[rows[first], bucket[first]] = zeros << np.uint64(mantissa_bits) | mantissa
    return out


def band_keys(coarse: np.ndarray) -> np.ndarray:
    """Key of each band of each row, 0 where all of its registers are empty."""
    parts = np.ascontiguousarray(coarse).view(np.uint64).reshape(len(coarse), BANDS)
    keys = arrays.mix(parts ^ arrays.mix(np.arange(1, BANDS + 1, dtype=np.uint64)))
    return np.where(parts == np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), keys)


@lru_cache(64)
def random_matches(log2_size: int) -> float:
    """Fine registers in which two unrelated sets of 2^log2_size elements agree, on average."""
    bucket_bits, mantissa_bits = FINE
    rate = 2.0 ** (log2_size - bucket_bits)
    zeros = np.arange(0, (EMPTY[FINE] >> mantissa_bits) - 1)[:, None]
    width = 2.0 ** -(zeros + 1 + mantissa_bits)
    at = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << mantissa_bits)[None, :] / (1 << mantissa_bits))
    cell = np.exp(-rate * at) * -np.expm1(-rate * width)
    return float((cell**2).sum() * (1 << bucket_bits))


def estimates(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs of fine registers, and registers compared. sizes: of the smaller sets."""
    empty = EMPTY[FINE]
    used = ((a != empty) | (b != empty)).sum(-1)
    same = ((a == b) & (a != empty)).sum(-1)
    chance = np.array([random_matches(i) for i in range(40)])[np.log2(np.maximum(sizes, 1)).astype(int)]
    # unrelated registers agree by chance, of those that the sets do not share
    guess = (same - chance) / np.maximum(used - chance, 1e-9)
    return np.clip(guess, 0, 1), used


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches leave a link possible, and the estimates."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    guess, used = estimates(a, b, low)
    share = percent / 100
    return (100 * low >= percent * high) & (guess >= share - MARGIN * np.sqrt(share * (1 - share) / np.maximum(used, 1))), guess


SKETCH = "doc_id long, mark long, n_shingles long, set_key binary, bands binary, registers binary"


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, set_key (128 bits, equal for equal sets), band keys and fine registers; no shuffle."""
    ship_package(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in arrays.text_slices(batch.column(2)):
                n = end - first
                rows, values = shingle_sets(data, offsets)
                counts = np.bincount(rows, minlength=n)
                keys = np.zeros((n, 2), np.uint64)
                starts = np.cumsum(counts) - counts
                full = counts > 0
                if full.any():
                    keys[full, 0] = np.add.reduceat(values, starts[full])
                    keys[full, 1] = np.bitwise_xor.reduceat(arrays.mix(values), starts[full])
                bands, fine = band_keys(registers(rows, values, n, COARSE)), registers(rows, values, n, FINE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(counts, pa.int64()), arrays.binary_column(keys.ravel(), np.full(n, 2)),
                     arrays.binary_column(bands.ravel(), np.full(n, BANDS)), arrays.binary_column(fine.ravel(), np.full(n, fine.shape[1]))],
                    ["doc_id", "mark", "n_shingles", "set_key", "bands", "registers"],
                )

    return written(documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text"), arrays.tidied(run), SKETCH, "sketches")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()])


def _bands(sketches: DataFrame) -> DataFrame:
    """(key, id, n) for every band of every class that has a register."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = _matrix(batch.column(2), np.uint64)
                rows, bands = np.nonzero(keys)
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows, bands].view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken)], ["key", "id", "n"])

    return written(sketches.select("id", "n", "bands"), arrays.tidied(run), "key long, id long, n long", "bands")


class Corpus:
    """Classes of equal sets, the texts that stand for them, and the threshold in percent."""

    def __init__(self, documents: DataFrame, classes: DataFrame, sketches: DataFrame, percent: int):
        self.documents, self.classes, self.sketches, self.percent = documents, classes, sketches, percent

    def with_texts(self, named: DataFrame, expected: int) -> DataFrame:
        """The rows (with an id), and the text of that class. Only texts that may be wanted are shuffled."""
        named = named.join(self.classes.select("id", "of", "mark"), "id")
        texts = self.documents.select(F.col("doc_id").cast("long").alias("of"), F.xxhash64("text").alias("mark"), "text").where("of IS NOT NULL AND text IS NOT NULL")
        texts = likely(texts, F.xxhash64("of", "mark"), named.select(F.xxhash64("of", "mark").alias("key")), "key", expected)
        return named.join(texts.dropDuplicates(["of", "mark"]).hint("merge"), ["of", "mark"])

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches leave a link possible."""
        one = self.sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
        other = self.sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
        percent = self.percent

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    r_a, r_b = (_matrix(batch.column(i), np.uint8) for i in (4, 5))
                    yield batch.select(["a", "b"]).filter(pa.array(may_link(r_a, r_b, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)[0]))

        rows = pairs.join(other.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "n_a", "n_b", "r_a", "r_b")
        return written(rows, arrays.tidied(run), PAIR, "possible")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of a written table that are links, decided on full sets.

        Members meet a copy of their leader's text: a leader with many members has a copy for each MEMBERS of them,
        so no task holds more than one leader's set and a batch of members.
        """
        copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
        members = pairs.join(copies, "a").select("a", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"), F.lit(1).alias("member"), F.col("b").alias("id"))
        leaders = copies.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("member"), F.col("a").alias("id"))
        needed = self.with_texts(members.unionByName(leaders), 2 * pairs.count()).select("a", "copy", "member", "id", "text")
        percent = self.percent

        def run(batches):
            leader = None
            for _, rows in pieces_by_key(batches, 2):
                at = 0
                if rows.column(2)[0].as_py() == 0:
                    for _, _, data, offsets in arrays.text_slices(rows.column(4).slice(0, 1)):
                        leader = shingle_sets(data, offsets)[1]
                    at = 1
                linked = []
                for first, _, data, offsets in arrays.text_slices(rows.column(4).slice(at)) if rows.num_rows > at else ():
                    of, values = shingle_sets(data, offsets)
                    common = np.bincount(of, np.searchsorted(leader, values, "right") > np.searchsorted(leader, values), len(offsets) - 1)
                    union = np.bincount(of, minlength=len(offsets) - 1) + len(leader) - common
                    linked += (at + first + np.flatnonzero(100 * common >= percent * union)).tolist()
                if linked:
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(linked)), rows.column(3).take(pa.array(linked))], ["a", "b"])

        dealt = needed.repartition("a", "copy").sortWithinPartitions("a", "copy", "member")
        return written(dealt, arrays.tidied(run), PAIR, "links")

    def cells(self, crowded: DataFrame, found: DataFrame) -> DataFrame:
        """(key, i, j, own, id, n, component, bands, registers): the band buckets that hold several components.

        A bucket's minor classes, those outside its most frequent component, lie in its first blocks, and the others in
        blocks behind. Each pair of blocks (i, j) with a minor one is a cell; `own` is the class's block.
        """
        rows = crowded.join(found.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = rows.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
        top = F.max_by(F.struct("component", "size", "weight"), F.struct("size", "component"))
        keys = parts.groupBy("key").agg(F.count("*").alias("parts"), top.alias("main"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).where("parts > 1")
        blocks = lambda size, weight: F.greatest(F.lit(1), F.ceil(F.greatest(size / BLOCK, weight / SHINGLES))).cast("int")
        # a bucket that fits in one block is one cell
        mains = F.when(blocks(F.col("size"), F.col("weight")) == 1, 0).otherwise(blocks(F.col("main.size"), F.col("main.weight")))
        minors = blocks(F.col("size") - F.col("main.size"), F.col("weight") - F.col("main.weight"))
        keys = keys.select("key", F.when(mains > 0, F.col("main.component")).alias("main"), minors.alias("minors"), mains.alias("mains"))
        rows, is_main = rows.join(keys, "key"), F.col("component").eqNullSafe(F.col("main"))
        own = F.when(is_main, F.col("minors") + F.pmod(F.xxhash64("id", F.lit(3)), "mains")).otherwise(F.pmod(F.xxhash64("id", F.lit(3)), "minors")).cast("int")
        others = F.sequence(F.lit(0), F.when(is_main, F.col("minors")).otherwise(F.col("minors") + F.col("mains")) - 1)
        cells = rows.withColumn("own", own).withColumn("other", F.explode(others))
        cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "component")
        cells = cells.join(self.sketches.select("id", "bands", "registers"), "id").select("key", "i", "j", "own", "id", "n", "component", "bands", "registers")
        return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def best_pairs(self, cells: DataFrame) -> DataFrame:
        """The pair of the highest estimate for each asking class, block and band."""
        percent = self.percent

        def run(batches):
            for cell in groups(batches, 3):
                pairs = [tuple(sorted((x, others[np.argmax(guess)]))) for x, others, guess in _cell_pairs(cell, percent, True)]
                if pairs:
                    a, b = zip(*pairs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return cells.mapInArrow(arrays.tidied(run), PAIR).distinct()

    def links_in_cells(self, cells: DataFrame) -> DataFrame:
        """The links (a, b) among all pairs of the cells that may be links.

        A cell names the classes that it needs and, for each, those to compare it with; texts come once to a cell, not
        once to a pair, and a cell has two blocks of classes at most.
        """
        names = ["key", "i", "j", "id", "others"]
        schema = "key long, i int, j int, id long, others array<long>"
        percent = self.percent

        def ask(batches):
            for cell in groups(batches, 3):
                rows = [(x, others.tolist()) for x, others, _ in _cell_pairs(cell, percent, False)]
                if rows:
                    named = sorted({x for x, _ in rows} | {y for _, others in rows for y in others})
                    place = [pa.array([cell.column(k)[0].as_py()] * (len(named) + len(rows)), t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
                    ids, others = [*named, *(x for x, _ in rows)], [*([None] * len(named)), *(o for _, o in rows)]
                    yield pa.RecordBatch.from_arrays([*place, pa.array(ids, pa.int64()), pa.array(others, pa.list_(pa.int64()))], names)

        asked = written(cells, arrays.tidied(ask), schema, "cells")
        named = asked.where("others IS NULL").select("key", "i", "j", "id")
        rows = self.with_texts(named, named.count()).select("key", "i", "j", "id", F.lit(None).cast("array<long>").alias("others"), "text")
        rows = rows.unionByName(asked.where("others IS NOT NULL").withColumn("text", F.lit(None).cast("string")))

        def decide(batches):
            for cell in groups(batches, 3):
                sets: dict[int, np.ndarray] = {}
                known = cell.filter(pa.compute.is_valid(cell.column(5)))
                for first, end, data, offsets in arrays.text_slices(known.column(5).combine_chunks()) if known.num_rows else ():
                    of, values = shingle_sets(data, offsets)
                    parts = np.split(values, np.searchsorted(of, np.arange(1, end - first)))
                    sets.update(zip(known.column(3)[first:end].to_pylist(), parts, strict=True))
                links = []
                for x, others in zip(cell.column(3).to_pylist(), cell.column(4).to_pylist(), strict=True):
                    for y in others or ():
                        a, b = sets[x], sets[y]
                        common = int((np.searchsorted(a, b, "right") > np.searchsorted(a, b)).sum())
                        if 100 * common >= percent * (len(a) + len(b) - common):
                            links.append((min(x, y), max(x, y)))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return written(dealt, arrays.tidied(decide), PAIR, "last-links")


PAIR = "a long, b long"


def _cell_pairs(cell: pa.Table, percent: int, both_ways: bool):
    """(id, ids, estimates) of the classes of block i: those of block j and of other components that share their first band here and may link."""
    key, i, j = (cell.column(k)[0].as_py() for k in range(3))
    own, ids, n, component = (cell.column(k).to_numpy() for k in (3, 4, 5, 6))
    bands, fine = _matrix(cell.column(7), np.uint64), _matrix(cell.column(8), np.uint8)
    at = int(np.flatnonzero(bands[0] == np.int64(key).view(np.uint64))[0])
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for x in left:
        others = right[(component[right] != component[x]) & ((i != j) | (right > x) | both_ways)]
        others = others[100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])]
        if not len(others):
            continue
        fits, guess = may_link(fine[x][None, :], fine[others], np.full(len(others), n[x]), n[others], percent)
        fits &= ~((bands[others, :at] == bands[x, :at]) & (bands[x, :at] != 0)).any(1)
        if fits.any():
            yield ids[x], ids[others[fits]], guess[fits]


def _edges(found: DataFrame) -> DataFrame:
    """The links that components amount to."""
    return found.select(F.col("id").alias("a"), F.col("component").alias("b"))


def set_links(documents: DataFrame, every: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes (set_key, of, mark, id: the first row that has the set) and their components (id, component).

    `every` is dropped when it is read, and so are the bands: nothing wide lies on disk beside the cells.
    """
    full = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    # ids are places in this table, which is written once
    classes = checkpointed(first.select("set_key", F.col("first.doc_id").alias("of"), F.col("first.mark").alias("mark"), F.monotonically_increasing_id().alias("id")), "classes")
    # wide rows are written twice at most: as made, and one for each class
    heads = full.withColumnRenamed("doc_id", "of").join(classes, ["set_key", "of", "mark"])
    sketches = checkpointed(heads.select("id", F.col("n_shingles").alias("n"), "bands", "registers").dropDuplicates(["id"]), "class-sketches")
    discard(every)
    corpus = Corpus(documents, classes, sketches, percent)
    bands = _bands(sketches)
    heads = bands.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1")
    stars = bands.join(heads, "key").where("a <> id").select("a", F.col("id").alias("b"), (F.col("size") > FEW).alias("crowded"))
    one = stars.where("crowded").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    stars = stars.where("NOT crowded").select("a", "b").unionByName(one).distinct()
    tried = corpus.possible(stars)
    links = corpus.linked(tried)
    found = components(links)
    # buckets of two are done: their one pair has been tried
    full_keys = bands.groupBy("key").count().where("count > 2").select("key")
    crowded = checkpointed(bands.join(full_keys, "key"), "crowded")
    discard(bands)
    settle(documents.sparkSession)
    for _ in range(ROUNDS):
        more = checkpointed(corpus.best_pairs(corpus.cells(crowded, found)).join(tried, ["a", "b"], "left_anti"), "best")
        if not more.isEmpty():
            tried = tried.unionByName(more)
            found = joined(found, corpus.linked(more))
    return classes, joined(found, corpus.links_in_cells(corpus.cells(crowded, found)))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    return found if links.isEmpty() else components(_edges(found).unionByName(links))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; then mark (hash of its text) and text_kept.

    text_kept looks at texts, not nodes: whether the row has the first doc_id and text of all that links reach from its
    text. It differs from kept only where rows of one doc_id have several texts.
    """
    wide = sketch(documents)
    every = checkpointed(wide.select("doc_id", "mark", "n_shingles", "set_key"), "sets")
    classes, found = set_links(documents, wide, percent)
    # texts of one doc_id join their classes
    full = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least <> most").select("doc_id")
    several = full.select("doc_id", "set_key").join(several, "doc_id", "left_semi").distinct().join(classes.select("set_key", "id"), "set_key")
    same = checkpointed(several.join(several.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b")), "same-ids")

    def tops(found: DataFrame, alias: str) -> DataFrame:
        """set_key and the first row (doc_id, mark) of each class's component."""
        own = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = own.groupBy("component").agg(F.min(F.struct("of", "mark")).alias(alias))
        return own.join(least, "component").select("set_key", alias)

    by_text = tops(found, "text_top")
    both = by_text.withColumn("top", F.col("text_top")) if same.isEmpty() else by_text.join(tops(joined(found, same), "top"), "set_key")
    settle(documents.sparkSession)
    out = every.select("doc_id", "n_shingles", "mark", "set_key").join(both, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("top.of", "doc_id"))
    first = F.col("text_top").isNull() | F.col("doc_id").isNull() | ((F.col("text_top.of") == F.col("doc_id")) & (F.col("text_top.mark") == F.col("mark")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "mark", first.alias("text_kept"))
