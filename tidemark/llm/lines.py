"""Line dedup by an exact set-similarity join.

A line (split at \\n) is the set of its words (A-Z lower-cased, split at ASCII white space). A line with a word is
removed if an earlier line - smaller doc_id, or the same document and further up - has a Jaccard similarity of THRESHOLD
or more with it. Earlier lines count whether or not they are removed themselves.

1. Word counts over the whole corpus, in a table of fixed size by word hash, order words by rarity.
2. Equal sets are one class, whose first line stands for it.
3. Each class is entered under the words of its prefix, the n - ceil(THRESHOLD n) + 1 rarest; those of fewer than
   UNEQUAL words are not, as nothing but an equal set is similar enough. Two sets that are similar enough share a prefix
   word, and a second one in the prefix that is longer by one: a word with more than COMMON entries is replaced by its
   pairs with the words behind it there, so common words make no crowd.
4. Entries are counted by cell of their hash, and cells are laid together into tasks of bounded size before anything is
   shuffled. A cell of more than BLOCK entries is split by place.
5. Within a key, a pair is a candidate if its sizes, the places of the word in both (words left after it bound the
   overlap) and the bits that differ in two 128-bit sketches (parities of the words by hash: no more than the sets' difference) allow it. Only the
   existence of one earlier match matters: a class first tries its FIRST earliest candidates under each key of its task.
   Those it has in vain, with candidates left or in a split cell, try all the others in a second round: they go to every
   part of their cells, the others to one, so copies of one line cost a few rows each.
6. Candidates are decided on the full word sets (64-bit word hashes).

Cases: null texts stay null and have no lines. Lines without words always stay. Rows that repeat doc_id and
text share their lines' places, so they keep the same lines; rows of one doc_id with other texts are ordered by a hash
of the text. Null doc_ids come first. Very long lines are ordinary; a text is worked on whole, in one task. Further
columns pass through, but columns named n_lines or n_removed give way to the results. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays, packed
from tidemark.llm.filters import KeyFilter
from tidemark.session import checkpointed, settle, ship_package, written

THRESHOLD = (9, 10)
#: Distinct words of the smallest set that can be similar enough to another without being equal: 9, to one of 10.
UNEQUAL = -(-THRESHOLD[0] // (THRESHOLD[1] - THRESHOLD[0]))
#: Bits of the number of counters of the word table: a fixed size, however large the corpus; most for the entries' cells.
WORD_BITS, CELL_BITS = 20, 24
#: Earlier candidates that a class tries in the first round, for each key.
FIRST = 4
#: Entries of a word from which it is entered with a second one; of a cell before it is split; of a task.
COMMON, BLOCK, TOGETHER = 2048, 16_384, 100_000
#: Lines of a task, when classes are made and when lines are gathered by document.
LINES = 60_000
#: Pairs that are looked at together in the second round.
PAIRS = 500_000
NULL_ID = -(1 << 63)
PLACE = [("doc", "<i8"), ("mark", "<i8"), ("line", "<i4")]
CLASS = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("s0", "<u8"), ("s1", "<u8"), *PLACE, ("n", "<i4")])
#: An entry of a class under a key; flag: 0 in a whole cell, 1 in a split one, 2 for a class that asks in the second round.
ENTRY = np.dtype([("key", "<u8"), ("s0", "<u8"), ("s1", "<u8"), *PLACE, ("n", "<i4"), ("at", "<i4"), ("flag", "<i4")])
OWN = np.dtype([*PLACE, ("gone", "<i4")])
TABLE = "records binary, words binary"
PAIR = "later long, earlier long, more boolean"


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words that sets of these sizes need: ceil(t / (1 + t) (a + b))."""
    x, y = THRESHOLD
    return -(-(a + b) * x // (x + y))


def need_of_one(n: np.ndarray) -> np.ndarray:
    """Words that a set of n must share with any similar set."""
    x, y = THRESHOLD
    return -(-n * x // y)


def place_key(doc_id: np.ndarray, mark: np.ndarray, line: np.ndarray) -> np.ndarray:
    """64-bit hash of a line's place."""
    x = arrays.mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    x = arrays.mix(x ^ mark.astype(np.int64).view(np.uint64))
    return arrays.mix(x + line.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def place_of(records: np.ndarray | dict[str, np.ndarray]) -> np.ndarray:
    """The place keys of records."""
    return place_key(np.ascontiguousarray(records["doc"]), np.ascontiguousarray(records["mark"]), records["line"])


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of a slice (a text of n line ends has n + 1 lines), and lines before each row."""
    ends = np.flatnonzero(data == 10) + 1
    return np.sort(np.concatenate([ends, offsets])), np.searchsorted(ends, offsets, "right") + np.arange(len(offsets))


def line_words(data: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (line, word hash) pairs."""
    data = arrays.lowered(data)
    starts, ends, words = arrays.word_spans(data, lines, arrays.SPACE)
    return arrays.distinct_in_rows(np.repeat(np.arange(len(lines) - 1), np.diff(words)), arrays.span_hashes(data, starts, ends))


def _row_slices(batch: pa.RecordBatch):
    """(doc_ids, marks, bytes, line offsets, lines before each row) of slices of (doc_id, mark, text)."""
    doc_id = batch.column(0).fill_null(NULL_ID).to_numpy()
    mark = batch.column(1).to_numpy()
    for first, end, data, offsets in arrays.text_slices(batch.column(2)):
        lines, before = line_offsets(data, offsets)
        yield doc_id[first:end], mark[first:end], data, lines, before


def _source(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("mark"), "text").where("text IS NOT NULL")


def _parallel(documents: DataFrame, rows: int, each: int) -> int:
    """Tasks for so many rows: those of the session's shuffles at least."""
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def word_counts(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Occurrences of the words of each hash cell over all texts, and lines in all; tasks add theirs up first."""
    size = 1 << WORD_BITS

    def run(batches):
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in arrays.text_slices(batch.column(0)):
                data = arrays.lowered(data)
                starts, ends, _ = arrays.word_spans(data, offsets, arrays.SPACE)
                np.add.at(seen, (arrays.span_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64), 1)
                seen[size] += len(offsets) - 1 + int((data == 10).sum())
        yield from packed.count_rows(seen)

    counts = packed.totals(documents.select("text").mapInArrow(arrays.tidied(run), packed.SCHEMA), size + 1)
    return counts[:size], int(counts[size])


def _first_of_sets(records: np.ndarray) -> np.ndarray:
    """Of records of equal sets, the one that comes first."""
    order = np.lexsort((records["line"], records["mark"], records["doc"], records["k2"], records["k1"]))
    k1, k2 = records["k1"][order], records["k2"][order]
    first = np.ones(len(order), bool)
    first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    return order[first]


def word_runs(n: np.ndarray) -> np.ndarray:
    """Words of a class that its record carries: its prefix and one more."""
    return np.where(n >= UNEQUAL, n - need_of_one(n) + 2, 0)


def first_lines(documents: DataFrame, counts: np.ndarray, n_lines: int) -> DataFrame:
    """The classes (CLASS records of their first lines, with their rarest words in order), in rows of many.

    A task sends a class once for each Outbox, so a line that a third of all rows have takes no third of the shuffle.
    """
    spark = documents.sparkSession
    # frequencies matter only as an order: half-octave steps
    shared = spark.sparkContext.broadcast(np.round(2 * np.log2(1 + counts)).astype(np.uint8))
    n_buckets = _parallel(documents, n_lines, LINES)

    def send(batches):
        out = packed.Outbox(_first_of_sets)
        for batch in batches:
            for doc_id, mark, data, lines, before in _row_slices(batch):
                row, word = line_words(data, lines)
                if not len(row):
                    continue
                sizes = np.bincount(row, minlength=len(lines) - 1)
                own = np.flatnonzero(sizes)
                n = sizes[own]
                starts = np.cumsum(n) - n
                records = np.zeros(len(own), CLASS)
                records["k1"], records["k2"] = np.add.reduceat(word, starts), np.bitwise_xor.reduceat(arrays.mix(word), starts)
                doc = np.searchsorted(before, own, "right") - 1
                records["doc"], records["mark"], records["line"], records["n"] = doc_id[doc], mark[doc], own - before[doc], n
                one = np.uint64(1) << (word & np.uint64(63))
                for half, name in enumerate(("s0", "s1")):
                    records[name] = np.bitwise_xor.reduceat(np.where((word >> np.uint64(6)) & np.uint64(1) == half, one, np.uint64(0)), starts)
                # words by rarity within their line; the rarer half-octave first, then by hash
                long = n >= UNEQUAL
                some = np.repeat(long, n)
                word = word[some]
                if len(word):
                    word = word[rarity_order(np.repeat(np.arange(len(own)), n)[some], shared.value[(word >> np.uint64(64 - WORD_BITS)).astype(np.int64)], word)]
                length, m = word_runs(n), np.where(long, n, 0)
                begin = np.cumsum(m) - m
                out.add(packed.bucket_of(records["k1"], n_buckets), records, word[np.repeat(begin, length) + packed.ramp(length)], length)
                yield from out.rows()
        yield from out.rows(True)

    def first_of(batches):
        records, words = packed.whole(batches, CLASS)
        pick = _first_of_sets(records)
        length = word_runs(records["n"])
        yield from packed.stored(records[pick], packed.take_runs(words, length, pick), length[pick])

    rows = packed.dealt(_source(documents).mapInArrow(arrays.tidied(send), packed.SCHEMA), n_buckets)
    return written(rows, arrays.tidied(first_of), TABLE, "line-classes")


def rarity_order(row: np.ndarray, steps: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by row, rarity step, hash: as one number where its bits tell all words of a line apart, else in full."""
    rows = max(1, int(row.max()).bit_length())
    joint = row.astype(np.uint64) << np.uint64(64 - rows) | steps.astype(np.uint64) << np.uint64(56 - rows) | word >> np.uint64(8 + rows)
    order = np.argsort(joint)
    joint = joint[order]
    return np.lexsort((word, steps, row)) if (joint[1:] == joint[:-1]).any() else order


def class_batches(batches):
    """(records, words) of each row of a table of classes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield packed.joined(batch.column(0).slice(i, 1), CLASS), packed.joined(batch.column(1).slice(i, 1), np.uint64)


def keys_of(records: np.ndarray, words: np.ndarray, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, key, place of its first word) of every entry. common: by cell, whether its words need a second one."""
    length = word_runs(records["n"])
    row, at = np.repeat(np.arange(len(length)), length), packed.ramp(length)
    left = length[row] - 1 - at  # words of the run behind this one; the last is no prefix word
    crowded = np.zeros(len(words), bool) if common is None else common[cells(words, len(common))]
    alone = np.flatnonzero((left > 0) & ~crowded)
    first = np.flatnonzero((left > 0) & crowded)
    first = np.repeat(first, left[first])
    second = first + 1 + packed.ramp(left[np.flatnonzero((left > 0) & crowded)])
    pairs = arrays.mix(words[first] * np.uint64(0x9E3779B97F4A7C15) + words[second])
    return np.concatenate([row[alone], row[first]]), np.concatenate([words[alone], pairs]), np.concatenate([at[alone], at[first]])


def cells(keys: np.ndarray, n: int) -> np.ndarray:
    """The cell of each key; n is a power of two."""
    return (keys >> np.uint64(65 - n.bit_length())).astype(np.int64)


def key_counts(classes: DataFrame, n: int, common: np.ndarray | None) -> np.ndarray:
    """Entries in each of n cells."""
    shared = classes.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen = np.zeros(n, np.int64)
        for records, words in class_batches(batches):
            np.add.at(seen, cells(keys_of(records, words, shared.value)[1], n), 1)
        yield from packed.count_rows(seen)

    return packed.totals(classes.mapInArrow(arrays.tidied(run), packed.SCHEMA), n)


class Layout:
    """Which task an entry goes to: whole cells together up to a bound, crowded ones split by place."""

    def __init__(self, counts: np.ndarray, common: np.ndarray, n_tasks: int):
        self.common, some = common, counts[counts > 1]
        self.block = max(BLOCK, 4 * int(some.mean()) if len(some) else 0)
        self.crowded = np.flatnonzero(counts > self.block)
        self.parts = -(-counts[self.crowded] // self.block)
        ordinary = np.where((counts > 1) & (counts <= self.block), counts, 0)
        together = min(max(int(ordinary.sum()) // n_tasks, TOGETHER // 5), TOGETHER)
        self.task = ((np.cumsum(ordinary) - ordinary) // together).astype(np.int32)
        self.task[counts < 2] = -1  # a lone entry has no partner
        self.first = int(self.task.max(initial=-1)) + 1 + np.cumsum(self.parts) - self.parts
        self.n_tasks = max(1, int(self.task.max(initial=-1)) + 1 + int(self.parts.sum()))

    def send(self, key: np.ndarray, place: np.ndarray, everywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, task, whether its cell is split) of entries, one for each part of a split cell if `everywhere`."""
        cell = cells(key, len(self.task))
        task, index, split = self.task[cell].astype(np.int64), np.arange(len(key)), np.zeros(len(key), bool)
        if len(self.crowded):
            at = np.minimum(np.searchsorted(self.crowded, cell), len(self.crowded) - 1)
            split = self.crowded[at] == cell
            if everywhere:
                copies = np.where(split, self.parts[at], 1)
                index, part = np.repeat(index, copies), packed.ramp(copies)
                task, split, at = task[index], split[index], at[index]
                task = np.where(split, self.first[at] + part, task)
            else:
                task = np.where(split, self.first[at] + (place.view(np.uint64) % self.parts[at].astype(np.uint64)).astype(np.int64), task)
        good = task >= 0
        return index[good], task[good], split[good]


def layout(classes: DataFrame, n_classes: int) -> Layout:
    """Counts the entries, twice: of single words, which shows the common ones, and of all keys."""
    n = 1 << min(max(n_classes.bit_length() - 5, WORD_BITS), CELL_BITS)
    single = key_counts(classes, n, None)
    common = single > max(COMMON, 8 * single.mean())
    return Layout(key_counts(classes, n, common) if common.any() else single, common, _parallel(classes, 0, 1))


def allowed(entries: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes, places and sketches leave pairs of entries possible."""
    n, at = entries["n"], entries["at"]
    common = need(n[x], n[y])
    fine = np.flatnonzero(np.minimum(n[x] - at[x], n[y] - at[y]) >= common)
    apart = sum(np.bitwise_count(entries[s][x[fine]] ^ entries[s][y[fine]]).astype(np.int64) for s in ("s0", "s1"))
    out = np.zeros(len(x), bool)
    out[fine] = apart <= (n[x] + n[y] - 2 * common)[fine]
    return out


def in_order(entries: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of the entries whose key is not theirs alone, by key and place, and the number of each one's key.

    A class that asks comes before its own entry, so it does not meet itself.
    """
    order = np.argsort(entries["key"])
    key = entries["key"][order]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    entries = entries[order[shared]]
    entries = entries[np.lexsort((-entries["flag"], entries["line"], entries["mark"], entries["doc"], entries["key"]))]
    columns = {name: np.ascontiguousarray(entries[name]) for name in ENTRY.names}
    key = columns["key"]
    return columns, np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def earliest_pairs(entries: dict[str, np.ndarray], group: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, more): each entry's `first` earliest allowed partners within its group, and if it has others.

    All entries meet the first one of their group, then the second, and so on; one leaves at its first candidate too
    many, so a group of look-alikes costs each of its members a few steps.
    """
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    start = np.repeat(starts, np.diff(starts, append=len(group)))
    place = np.arange(len(start)) - start
    some, found, step = np.flatnonzero(place > 0), [(np.zeros(0, np.int64),) * 2], 0
    many, more = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    while len(some):
        good = some[allowed(entries, some, start[some] + step)]
        full = many[good] >= first
        more[good[full]] = True
        good = good[~full]
        many[good] += 1
        found.append((good, start[good] + step))
        step += 1
        some = some[(place[some] > step) & ~more[some]]
    later, earlier = (np.concatenate([f[i] for f in found]) for i in range(2))
    return later, earlier, more[later]


def all_pairs(entries: dict[str, np.ndarray], group: np.ndarray):
    """(later, earlier) of the allowed pairs of entries that ask with earlier ones that do not, some at a time."""
    asks = entries["flag"] == 2
    plain = np.flatnonzero(~asks)
    ask = np.flatnonzero(asks)
    starts = np.searchsorted(group, group[ask])
    low, high = np.searchsorted(plain, starts), np.searchsorted(plain, ask)
    at = 0
    while at < len(ask):
        end = max(at + 1, int(np.searchsorted(np.cumsum(high[at:] - low[at:]), PAIRS)) + at)
        counts = high[at:end] - low[at:end]
        later, earlier = np.repeat(ask[at:end], counts), plain[np.repeat(low[at:end], counts) + packed.ramp(counts)]
        good = allowed(entries, later, earlier)
        yield later[good], earlier[good]
        at = end


def candidates(classes: DataFrame, plan: Layout, only: tuple[KeyFilter, KeyFilter] | None = None) -> DataFrame:
    """(later, earlier, more): place keys of candidate pairs, and whether the later one has further candidates.

    The first round gives a class's FIRST earliest candidates under each key of its task; a class in a split cell also
    has a row without `earlier`. With `only` (classes and their keys), all candidates of those classes.
    """
    shared = classes.sparkSession.sparkContext.broadcast((plan, only))

    def enter(batches):
        plan, only = shared.value
        out = packed.Outbox()
        for records, words in class_batches(batches):
            row, key, at = keys_of(records, words, plan.common)
            place = place_of(records)
            rounds = [(0, np.ones(len(row), bool))]
            if only is not None:
                rounds = [(0, only[1].has(key)), (2, only[0].has(place)[row])]
            for flag, some in rounds:
                one, its_key = row[some], key[some]
                index, task, split = plan.send(its_key, place[one], flag == 2)
                entries = np.zeros(len(index), ENTRY)
                for name in ("s0", "s1", "doc", "mark", "line", "n"):
                    entries[name] = records[name][one[index]]
                entries["key"], entries["at"], entries["flag"] = its_key[index], at[some][index], np.where(split, 1, 0) if flag == 0 else 2
                out.add(task, entries)
                yield from out.rows()
        yield from out.rows(True)

    def pairs(batches):
        entries, _ = packed.whole(batches, ENTRY)
        alone = np.unique(place_of(entries[entries["flag"] == 1])) if shared.value[1] is None else np.zeros(0, np.int64)
        entries, group = in_order(entries)
        keys = place_of(entries)
        found = [(*earliest_pairs(entries, group, FIRST),)] if shared.value[1] is None else ((a, b, np.zeros(len(a), bool)) for a, b in all_pairs(entries, group))
        for later, earlier, more in found:
            later, earlier = keys[later], keys[earlier]
            for at in range(0, len(later), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000]) for x in (later, earlier, more)], ["later", "earlier", "more"])
        if len(alone):
            yield pa.RecordBatch.from_arrays([pa.array(alone), pa.nulls(len(alone), pa.int64()), pa.array(np.ones(len(alone), bool))], ["later", "earlier", "more"])

    rows = packed.dealt(classes.mapInArrow(arrays.tidied(enter), packed.SCHEMA), plan.n_tasks)
    found = rows.mapInArrow(arrays.tidied(pairs), PAIR)
    return found.groupBy("later", "earlier").agg(F.bool_or("more").alias("more"))


def asked_keys(classes: DataFrame, plan: Layout, keys: KeyFilter) -> DataFrame:
    """The keys of the classes with these place keys."""
    shared = classes.sparkSession.sparkContext.broadcast((plan.common, keys))

    def run(batches):
        common, keys = shared.value
        for records, words in class_batches(batches):
            row, key, _ = keys_of(records, words, common)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[keys.has(place_of(records))[row]]).view(np.int64))], ["key"])

    return classes.mapInArrow(arrays.tidied(run), "key long").distinct()


def similar(sides: list[pa.Array]) -> np.ndarray:
    """Whether the word sets (binary columns of distinct hashes) of each pair are similar enough."""
    words = [packed.joined(s, np.uint64) for s in sides]
    counts = [packed.lengths(s, np.uint64) for s in sides]
    row = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
    both, _ = arrays.distinct_in_rows(row, np.concatenate(words))
    union = np.bincount(both, minlength=len(counts[0]))
    return counts[0] + counts[1] - union >= need(*counts)


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, mark, line and key of the later lines of pairs that are similar enough, on full sets.

    A filter of the pairs' places says which lines send their words; the texts themselves are not shuffled.
    """
    places = pairs.select(F.explode(F.array("later", "earlier")).alias("key"))
    shared = documents.sparkSession.sparkContext.broadcast(KeyFilter(places, "key"))

    def send(batches):
        for batch in batches:
            for doc_id, mark, data, lines, before in _row_slices(batch):
                doc = np.repeat(np.arange(len(doc_id)), np.diff(before))
                line = np.arange(before[-1]) - before[doc]
                keys = place_key(doc_id[doc], mark[doc], line)
                size = np.diff(lines)
                some = np.flatnonzero(shared.value.has(keys) & (size >= 2 * UNEQUAL - 1))
                if len(some):
                    parts = data[np.repeat(lines[some], size[some]) + packed.ramp(size[some])]
                    row, word = line_words(parts, np.concatenate([[0], np.cumsum(size[some])]))
                    doc = doc[some]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (keys[some], doc_id[doc], mark[doc], line[some].astype(np.int32))), arrays.binary_column(word, np.bincount(row, minlength=len(some)))],
                        ["key", "doc", "mark", "line", "words"],
                    )

    def check(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["doc", "mark", "line", "key"]).filter(pa.array(similar([batch.column(4), batch.column(5)])))

    # what the filter lets through without need has no partner in the joins
    words = _source(documents).mapInArrow(arrays.tidied(send), "key long, doc long, mark long, line int, words binary").dropDuplicates(["key"])
    rows = pairs.join(words.select(F.col("key").alias("earlier"), F.col("words").alias("b")), "earlier")
    rows = rows.join(words.select(F.col("key").alias("later"), "doc", "mark", "line", F.col("words").alias("a")), "later")
    rows = rows.select("doc", "mark", "line", F.col("later").alias("key"), "a", "b")
    return rows.mapInArrow(arrays.tidied(check), "doc long, mark long, line int, key long").distinct()


def matched_lines(documents: DataFrame, classes: DataFrame, n_classes: int) -> DataFrame:
    """doc, mark, line, key of the classes' first lines that resemble an earlier line."""
    plan = layout(classes, n_classes)
    tried = checkpointed(candidates(classes, plan), "line-candidates")
    matched = checkpointed(verified(tried.where("earlier IS NOT NULL"), documents), "line-matches")
    left = checkpointed(tried.where("more").select("later").distinct().join(matched.withColumnRenamed("key", "later"), "later", "left_anti"), "line-left")
    if not left.isEmpty():
        keys = KeyFilter(left, "later")
        asked = KeyFilter(checkpointed(asked_keys(classes, plan, keys), "line-keys"), "key")
        rest = candidates(classes, plan, (keys, asked)).join(left, "later", "left_semi").join(tried.select("later", "earlier"), ["later", "earlier"], "left_anti")
        matched = matched.unionByName(checkpointed(verified(checkpointed(rest, "line-rest"), documents), "line-more"))
    return matched


def kept_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, lines): numbers (from 0, 32 bits each) of the lines with words of each document that stay."""
    ship_package(documents.sparkSession)
    counts, n_lines = word_counts(documents)
    classes = first_lines(documents, counts, n_lines)
    matched = matched_lines(documents, classes, n_lines)
    settle(documents.sparkSession)
    n_buckets = _parallel(documents, n_lines, 4 * LINES)

    def bucket(records):
        return packed.bucket_of(arrays.mix(records["doc"].view(np.uint64) ^ arrays.mix(records["mark"].view(np.uint64))), n_buckets)

    def send_classes(batches):
        out = packed.Outbox()
        for classes, _ in class_batches(batches):
            records = np.zeros(len(classes), OWN)
            for name, _ in PLACE:
                records[name] = classes[name]
            out.add(bucket(records), records)
            yield from out.rows()
        yield from out.rows(True)

    def send_matched(batches):
        out = packed.Outbox()
        for batch in batches:
            records = np.zeros(batch.num_rows, OWN)
            for name, column in zip(("doc", "mark", "line"), batch.columns, strict=True):
                records[name] = column.to_numpy()
            records["gone"] = 1
            out.add(bucket(records), records)
            yield from out.rows()
        yield from out.rows(True)

    def gather(batches):
        records, _ = packed.whole(batches, OWN)
        records = records[np.lexsort((records["gone"], records["line"], records["mark"], records["doc"]))]
        if not len(records):
            return
        doc, mark, line = (records[name] for name, _ in PLACE)
        stay = records["gone"] == 0
        # a line that is gone has a record behind its own
        stay[:-1] &= ~((doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (line[1:] == line[:-1]) & (records["gone"][1:] == 1))
        doc, mark, line = doc[stay], mark[stay], line[stay]
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(mark[first]), packed.binary(line, np.diff(first, append=len(line)))], ["doc_id", "mark", "lines"])

    rows = classes.mapInArrow(arrays.tidied(send_classes), packed.SCHEMA)
    rows = rows.unionByName(matched.select("doc", "mark", "line").mapInArrow(arrays.tidied(send_matched), packed.SCHEMA))
    return packed.dealt(rows, n_buckets).mapInArrow(arrays.tidied(gather), "doc_id long, mark long, lines binary")


def without_lines(data: np.ndarray, offsets: np.ndarray, stay: np.ndarray, stay_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, lines, lines removed) of texts whose lines are those named (by row and number) and those without words."""
    lines, before = line_offsets(data, offsets)
    size, row = np.diff(lines), np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    filled = np.concatenate([[0], np.cumsum(~arrays.SPACE[data])])
    keep = filled[lines[1:]] == filled[lines[:-1]]
    keep[before[stay_row] + stay] = True
    number = np.arange(len(size))
    last = np.full(len(offsets) - 1, -1)
    np.maximum.at(last, row[keep], number[keep])
    mask = np.repeat(keep, size)
    # lines are joined by line ends: none follows the last one that stays
    shorter = last[(last >= 0) & (last < before[1:] - 1)]
    mask[lines[shorter + 1] - 1] = False
    kept = np.concatenate([[0], np.cumsum(mask)])
    return data[mask], kept[offsets], np.diff(before), np.bincount(row[~keep], minlength=len(offsets) - 1)


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents with the text that stays, and n_lines and n_removed. Lines keep their order."""
    own = [c for c in documents.columns if c not in {"n_lines", "n_removed"}]
    keep = kept_lines(documents).withColumnRenamed("doc_id", "of").withColumnRenamed("mark", "of_mark")
    # the documents' own columns travel in a struct, whatever their names
    rows = documents.select(F.struct(*own).alias("row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("here"), F.xxhash64("text").alias("here_mark"))
    rows = rows.join(keep, (F.col("here") == F.col("of")) & (F.col("here_mark") == F.col("of_mark")), "left")
    at = own.index("text")
    schema = T.StructType([*documents.select(*own).schema, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in arrays.text_slices(batch.column(at)):
                part = batch.slice(first, end - first)
                lists = part.column(len(own)).fill_null(b"")
                stay_row = np.repeat(np.arange(end - first), packed.lengths(lists, np.int32))
                blob, places, n_lines, n_removed = without_lines(data, offsets, packed.joined(lists, np.int32), stay_row)
                null = part.column(at).is_null().to_numpy(zero_copy_only=False)
                texts = pa.Array.from_buffers(pa.large_string(), len(null), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(blob)])
                texts = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_string()), texts).cast(pa.string())
                columns = part.columns[: len(own)]
                columns[at] = texts
                counted = [pa.array(np.where(null, 0, x), pa.int64()) for x in (n_lines, n_removed)]
                yield pa.RecordBatch.from_arrays([*columns, *counted], [*own, "n_lines", "n_removed"])

    return rows.select("row.*", F.col("lines").alias("kept_line_numbers")).mapInArrow(arrays.tidied(run), schema)
