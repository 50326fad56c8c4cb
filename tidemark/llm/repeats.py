"""Removal of repeated byte strings, after prefix-free parsing.

Texts are UTF-8 bytes. A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or
the same document and further up); matches never cross documents.

Triggers: a rolling hash of WORD bytes; every window of LENGTH bytes has as its trigger its smallest hash, the leftmost
of equal ones. Triggers depend on the window's bytes alone, so equal windows have the same trigger at the same place,
and there is always one, whatever the text. Neighbouring windows mostly share it: one in about 35 bytes is a trigger.

Parse: a text becomes the sequence of its triggers. A phrase is a trigger with all bytes that its windows can touch;
phrases overlap, none is a proper prefix of another, and each is known by its trigger's hash and its own.

1. Array of the parse: its suffixes in order of (trigger, phrase, place). A phrase holds its windows whole, so a
   suffix of the parse is never looked at beyond its first phrase. Of equal phrases, the windows of all but the first
   are repeats. A phrase whose trigger no other phrase has, has no repeats. Repetitive text ends here.
2. Array of the dictionary: the other phrases - the first of each that share a trigger with different ones - send their
   windows (the phrases' suffixes, cut at LENGTH) in segments, keyed by the bytes that all windows of a segment have.
   Those of one key are put in order of their letters, eight a round; a suffix that stands alone drops out. Of equal
   ones, all but the first in the corpus are repeats.

Both arrays lie in parts, by hashes of triggers and of keys: which part comes first is no matter, as only equality and
the order of places within it are needed. Triggers are counted by cell before anything is shuffled. Those of cells with
more than `hot` are dealt by phrase, not by trigger, and their windows go one by one to an exchange by content with
partial aggregation, so no group is gathered in one task.

Cases: a null text is empty; one shorter than LENGTH keeps all. Rows that repeat doc_id and text are at the same places,
so neither makes the other a repeat; rows of one doc_id with other texts are ordered by a hash of the text. Null
doc_ids come first. Very long texts are worked on whole. Runs of one character have a trigger at each byte and cost as
much more. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrays, packed
from tidemark.session import settle, ship_package, written

LENGTH, WORD = 100, 32
REACH = LENGTH - WORD
SEGMENT = 24
#: Triggers of a cell from which it is hot; segments ordered together; records of a task of the parse.
HOT, TOGETHER, RECORDS = 40_000, 20_000, 150_000
#: Bits of the number of cells that triggers are counted in: the least and the most.
LEAST_BITS, MOST_BITS = 20, 24
#: A trigger of the parse; flag: HOT_WORD if its cell is hot, KNOWN if the slice has an equal phrase before it.
#: lo and hi, the first and last window, are so many bytes before the trigger.
PARSE = np.dtype([("word", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("x", "<i4"), ("lo", "u1"), ("hi", "u1"), ("flag", "u1"), ("", "u1")])
HOT_WORD, KNOWN = 1, 2
NULL_ID = -(1 << 63)
#: Windows of hot triggers that are made together.
WINDOWS = 200_000


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * arrays._table(len(data) + 1, False)[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of at least one byte."""
    return arrays.mix((sums[ends] - sums[starts]) * arrays._table(len(sums), True)[starts])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each window, by doubling."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    best = values
    while size < width:
        step = min(size, width - size)
        left, right = best[:-step], best[step:]
        lower = right < left
        best, at = np.where(lower, right, left), np.where(lower, at[step:], at[:-step])
        size += step
    return at


def triggers(data: np.ndarray, offsets: np.ndarray):
    """Of each trigger in a slice: place, row, first and last window, hash of its word, hash of its phrase."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = running_sums(data)
    words = span_hash(sums, np.arange(n - WORD + 1), np.arange(WORD, n + 1))
    owner = smallest(words, LENGTH - WORD + 1)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.flatnonzero(row_of[: n - LENGTH + 1] == row_of[LENGTH - 1 :])
    owner, row = owner[windows].astype(np.int64), row_of[windows]
    first = np.ones(len(windows), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    place, row, lo = owner[starts], row[starts], windows[starts]
    hi = windows[np.append(starts[1:], len(windows)) - 1] if len(starts) else lo
    left, right = np.maximum(offsets[row], place - REACH), np.minimum(offsets[row + 1], place + LENGTH)
    sides = ((place - left) * 256 + (right - place)).astype(np.uint64)
    return place, row, lo, hi, words[place], arrays.mix(span_hash(sums, left, right) + sides)


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _slices(batches):
    """PARSE records of each slice of (doc_id, mark, text), by trigger, phrase and place, with flag KNOWN."""
    for batch in batches:
        doc_id, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for begin, _, data, offsets in arrays.text_slices(batch.column(2)):
            place, row, lo, hi, word, phrase = triggers(data, offsets)
            records, base = np.zeros(len(place), PARSE), offsets[row]
            for name, values in (("word", word), ("phrase", phrase), ("doc", doc_id[begin + row]), ("mark", mark[begin + row]), ("x", place - base), ("lo", place - lo), ("hi", place - hi)):
                records[name] = values
            records = records[np.lexsort((records["x"], records["mark"], records["doc"], records["phrase"], records["word"]))]
            new, head = _heads(records)
            records["flag"] = np.where(~new & _elsewhere(records, head), KNOWN, 0)
            yield records


def _heads(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ordered records: whether each begins a phrase, and the first record of its phrase."""
    new = np.ones(len(records), bool)
    new[1:] = (records["word"][1:] != records["word"][:-1]) | (records["phrase"][1:] != records["phrase"][:-1])
    return new, np.maximum.accumulate(np.where(new, np.arange(len(records)), 0))


def _elsewhere(records: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether the records are at other places than those."""
    return (records["doc"] != records["doc"][head]) | (records["mark"] != records["mark"][head]) | (records["x"] != records["x"][head])


def _cells(words: np.ndarray, n: int) -> np.ndarray:
    # triggers are the smallest of many hashes, so they are mixed again
    return (arrays.mix(words) >> np.uint64(65 - n.bit_length())).astype(np.int64)


def trigger_counts(documents: DataFrame) -> np.ndarray:
    """Triggers in each cell of their hash that the parse will send; their number of cells grows with the corpus, within bounds."""
    size = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 << min(max((size // 35).bit_length() - 4, LEAST_BITS), MOST_BITS)

    def run(batches):
        seen = np.zeros(n, np.int64)
        for records in _slices(batches):
            np.add.at(seen, _cells(records["word"][records["flag"] == 0], n), 1)
        yield from packed.count_rows(seen)

    return packed.totals(_source(documents).where("text IS NOT NULL").mapInArrow(arrays.tidied(run), packed.SCHEMA), n)


def parse(documents: DataFrame, hot: int) -> DataFrame:
    """The array of the corpus's parse, as a written table: doc_id, mark, x, lo, hi, hot.

    x < 0 marks windows (lo to hi) that are repeats; the other rows are phrases that need a look at their windows. Of equal
    phrases a slice sends the first alone; the windows of the others are repeats whatever comes before.
    """
    counts = trigger_counts(documents)
    n_buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // RECORDS))
    some = counts[counts > 0]
    crowded = counts > max(hot, 4 * some.mean() if len(some) else 0)
    shared = documents.sparkSession.sparkContext.broadcast(crowded)

    def send(batches):
        out = packed.Outbox()
        for records in _slices(batches):
            is_hot = shared.value[_cells(records["word"], len(shared.value))]
            records["flag"] |= np.where(is_hot, HOT_WORD, 0).astype(np.uint8)
            route = np.where(is_hot, records["phrase"], records["word"])
            route = np.where(records["flag"] >= KNOWN, records["doc"].view(np.uint64) ^ records["x"].astype(np.uint64), route)
            out.add(packed.bucket_of(arrays.mix(route), n_buckets), records)
            yield from out.rows()
        yield from out.rows(True)

    def order(batches):
        records, _ = packed.whole(batches, PARSE)
        known = records[records["flag"] >= KNOWN]
        records = records[records["flag"] < KNOWN]
        records = records[np.lexsort((records["x"], records["mark"], records["doc"], records["phrase"], records["word"]))]
        new, head = _heads(records)
        repeats = records[~new & _elsewhere(records, head)]
        first = records[new]
        alone = np.ones(len(first), bool)
        alone[1:] &= first["word"][1:] != first["word"][:-1]
        alone[:-1] &= first["word"][1:] != first["word"][:-1]
        first = first[~alone | (first["flag"] == HOT_WORD)]
        rows = np.concatenate([known, repeats, first])
        sure = np.arange(len(rows)) < len(known) + len(repeats)
        for at in range(0, len(rows), 50_000):
            part, place = rows[at : at + 50_000], rows["x"][at : at + 50_000]
            x = np.where(sure[at : at + 50_000], np.int32(-1), place)
            columns = [pa.array(np.ascontiguousarray(a)) for a in (part["doc"], part["mark"], x, place - part["lo"], place - part["hi"])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part["flag"] & HOT_WORD == HOT_WORD)], ["doc_id", "mark", "x", "lo", "hi", "hot"])

    rows = packed.dealt(_source(documents).where("text IS NOT NULL").mapInArrow(arrays.tidied(send), packed.SCHEMA), n_buckets)
    return written(rows, arrays.tidied(order), "doc_id long, mark long, x int, lo int, hi int, hot boolean", "repeats-parse")


def segments(documents: DataFrame, unsure: DataFrame) -> DataFrame:
    """route, key, doc_id, mark, start, bytes: runs of windows of the phrases in question.

    Windows of hot triggers come one by one, without bytes: their key is a hash of their content. They need no key of theirs
    in one place, and so take a route by place.
    """
    lists = unsure.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("x", "lo", "hi", "hot")).alias("phrases"))
    rows = _source(documents).join(lists, (F.col("doc_id") == F.col("of")) & (F.col("mark") == F.col("of_mark"))).select("doc_id", "mark", "text", "phrases")
    rows = rows.dropDuplicates(["doc_id", "mark"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for begin, end, data, offsets in arrays.text_slices(part.column(2)):
                    lists = part.column(3).slice(begin, end - begin)
                    flat = lists.flatten()
                    counts = np.diff(lists.offsets.to_numpy())
                    row = np.repeat(np.arange(end - begin), counts)
                    x, lo, hi = (flat.field(i).to_numpy().astype(np.int64) + offsets[row] for i in range(3))
                    is_hot = flat.field(3).to_numpy(zero_copy_only=False)
                    sums = running_sums(data)
                    pieces = []
                    for s in range(0, REACH // SEGMENT + 1):
                        # windows that start s * SEGMENT up to the next multiple before the trigger
                        first, last = np.maximum(lo, x - (s + 1) * SEGMENT + 1), np.minimum(hi, x - s * SEGMENT)
                        some = np.flatnonzero((first <= last) & ~is_hot)
                        if len(some):
                            core = span_hash(sums, x[some] - s * SEGMENT, x[some] - (s + 1) * SEGMENT + 1 + LENGTH)
                            pieces.append((arrays.mix(core + np.uint64(s)), row[some], first[some], last[some]))
                    for one in np.array_split(np.flatnonzero(is_hot), 1 + int((hi - lo)[is_hot].sum()) // WINDOWS):
                        count = hi[one] - lo[one] + 1
                        at_row, start = np.repeat(row[one], count), np.repeat(lo[one], count) + packed.ramp(count)
                        content = span_hash(sums, start, start + LENGTH)
                        if len(start):
                            yield piece(part, begin, content, at_row, start - offsets[at_row], pa.nulls(len(start), pa.binary()), arrays.mix(content ^ arrays.mix(start.astype(np.uint64))))
                    if not pieces:
                        continue
                    key, row, first, last = (np.concatenate(p) for p in zip(*pieces, strict=True))
                    size = last - first + LENGTH
                    blob = data[np.repeat(first, size) + packed.ramp(size)]
                    yield piece(part, begin, key, row, first - offsets[row], arrays.binary_column(blob, size), key)

    def piece(part, begin, key, row, start, blob, route):
        of = pa.array(row + begin)
        columns = [pa.array(route.view(np.int64)), pa.array(key.view(np.int64)), part.column(0).take(of), part.column(1).take(of), pa.array(start.astype(np.int32)), blob]
        return pa.RecordBatch.from_arrays(columns, ["route", "key", "doc_id", "mark", "start", "bytes"])

    return rows.mapInArrow(arrays.tidied(run), "route long, key long, doc_id long, mark long, start int, bytes binary")


def suffix_array(data: np.ndarray, at: np.ndarray, order: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `data` at `at`, cut at LENGTH, in order of letters within groups; and whether each differs from the one before.

    `order` has the groups one after another, and `begins` says where one begins. Eight letters are a number, and each
    round sorts by the next; groups of one drop out. Equal suffixes keep the order that they had.
    """
    letters = np.ndarray(len(data) + 1, ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    order, begins = order.copy(), begins.copy()
    for step in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        size = np.diff(np.flatnonzero(begins), append=len(order))
        some = np.flatnonzero(np.repeat(size > 1, size))
        if not len(some):
            break
        group, own = np.cumsum(begins)[some], order[some]
        number = letters[at[own] + step].astype(np.uint64)
        again = np.lexsort((number, group))
        order[some], number = own[again], number[again]
        begins[some[1:]] |= (number[1:] != number[:-1]) | (group[1:] != group[:-1])
    return order, begins


def repeated_windows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Runs (doc_id, mark, lo, hi) of windows of some segments that equal an earlier one; keys are whole."""
    key, doc, mark, start = (table[c].to_numpy() for c in ("key", "doc_id", "mark", "start"))
    blobs = table["bytes"].combine_chunks()
    blobs = blobs.chunk(0) if isinstance(blobs, pa.ChunkedArray) else blobs
    data, size = packed.joined(blobs, np.uint8), packed.lengths(blobs, np.uint8)
    base, count = np.cumsum(size) - size, size - LENGTH + 1
    row = np.repeat(np.arange(len(size)), count)
    at = base[row] + packed.ramp(count)
    key, doc, mark, start = key[row], doc[row], mark[row], start[row] + packed.ramp(count)
    order = np.lexsort((start, mark, doc, key))
    begins = np.ones(len(order), bool)
    begins[1:] = key[order][1:] != key[order][:-1]
    order, begins = suffix_array(data, at, order, begins)
    doc, mark, start = doc[order], mark[order], start[order]
    head = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
    again = (doc != doc[head]) | (mark != mark[head]) | (start != start[head])
    doc, mark, start = doc[again], mark[again], start[again]
    order = np.lexsort((start, mark, doc))
    doc, mark, start = doc[order], mark[order], start[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return doc[first], mark[first], start[first].astype(np.int32), start[last].astype(np.int32)


RUNS = ["content", "doc_id", "mark", "lo", "hi"]


def order_windows(rows: DataFrame) -> DataFrame:
    """The arrays of the dictionary, as a written table content, doc_id, mark, lo, hi: runs of repeated windows (content null), and single windows of hot triggers."""

    def decided(tables):
        doc, mark, lo, hi = repeated_windows(pa.concat_tables(tables))
        return pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), *map(pa.array, (doc, mark, lo, hi))], RUNS)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            single = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            if single.any():
                hot = batch.filter(pa.array(single))
                yield pa.RecordBatch.from_arrays([hot.column(i) for i in (1, 2, 3, 4, 4)], RUNS)
                batch = batch.filter(pa.array(~single))
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= TOGETHER:
                # all but the last key are whole
                table = pa.concat_tables(held)
                key = table["key"].to_numpy()
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield decided([table.slice(0, whole)])
                held, size = [table.slice(whole)], len(key) - whole
        if size:
            yield decided(held)

    dealt = rows.repartition("route").sortWithinPartitions("key", "doc_id", "mark", "start")
    return written(dealt, arrays.tidied(run), "content long, doc_id long, mark long, lo int, hi int", "repeats-windows")


def order_contents(rows: DataFrame) -> DataFrame:
    """Runs (doc_id, mark, lo, hi) of those windows, each a row, that equal an earlier one."""
    first = rows.groupBy("content").agg(F.min(F.struct("doc_id", "mark", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = rows.join(first.select("content", "first"), "content").where(F.struct("doc_id", "mark", "lo") != F.col("first"))
    return found.select("doc_id", "mark", "lo", "hi")


def repeated_runs(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, mark, lo, hi: windows lo to hi of a document also start earlier; null doc_ids as NULL_ID."""
    ship_package(documents.sparkSession)
    parsed = parse(documents, hot)
    settle(documents.sparkSession)
    windows = order_windows(segments(documents, parsed.where("x >= 0")))
    settle(documents.sparkSession)
    runs = parsed.where("x < 0").select("doc_id", "mark", "lo", "hi")
    runs = runs.unionByName(windows.where("content IS NULL").select("doc_id", "mark", "lo", "hi"))
    return runs.unionByName(order_contents(windows.where("content IS NOT NULL")))


def remove_repeats(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay, of every document."""
    runs = repeated_runs(documents, hot).groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    rows = documents.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(runs, (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                sizes.append(len(raw))
                if not runs.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw)
                    continue
                edges = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edges, runs.values.field(0).to_numpy(), 1)
                np.add.at(edges, runs.values.field(1).to_numpy() + LENGTH, -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            columns = [pa.array(c, pa.int64()) for c in (sizes, removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(arrays.tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, np.ndarray]:
    """The same by a table of all windows, for tests: which bytes of each document go."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, raw in sorted(texts):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            digest = hashlib.blake2b(raw[p : p + length], digest_size=12).digest()
            if digest in seen:
                gone[p : p + length] = True
            else:
                seen.add(digest)
        out[doc_id] = gone
    return out
