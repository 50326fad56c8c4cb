"""Token ids as directly addressable codes.

Each id is cut into chunks of `width` bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of
the ids that have one, and so on. A level's continuation bitmap says which of its ids go on; their place in the
next level is the number of set bits before them, which a rank directory (set bits before each block of 512)
and one popcount give. So any token, and any run of them, is reached in as many steps as it has chunks, without
decoding a block.

A file holds the documents of a run of doc_ids: a header with the places of all sections, the document directory
(doc_id, first token) and the levels. The body lies in pages of PAGE bytes whose checksums the header holds, so a reader
takes only the pages that it needs from the store, and each is verified.

Cases: a null text is an empty one and is the end id alone. Rows that repeat a doc_id follow each other, ordered by
text. Null doc_ids come first. Very long texts are encoded whole; they may make a file larger than others. An empty table
makes no file and no row. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays, storage
from tidemark.session import shared_dir, ship_package, written

MAGIC = b"TMDAC2\0\0"
BLOCK = 512
#: Bytes of a page, and pages that a reader remembers.
PAGE, PAGES = 1 << 16, 64
#: Tokens after which a writer closes its file and starts another.
ROLL_TOKENS = 4 << 20
#: Places for pieces that a worker remembers the ids of; half of them are used.
SLOTS = 1 << 21
#: ASCII marks besides the apostrophe.
MARKS = b".,;:!?|*#$%&()[]{}<>-+=/\"_~@^`\\"
NULL_ID = -(1 << 63)


def split_levels(ids: np.ndarray, width: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continuation flags) of each level."""
    kind = np.uint8 if width <= 8 else np.uint16
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> np.uint32(width)) > 0
        levels.append(((rest & np.uint32((1 << width) - 1)).astype(kind), more))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(width)


def pack(ids: np.ndarray, doc_ids: np.ndarray, firsts: np.ndarray, width: int = 8) -> bytes:
    """A whole file."""
    sections = [doc_ids.astype("<i8"), firsts.astype("<i8")]
    levels = split_levels(ids, width)
    for chunks, more in levels:
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<i8")
        sections += [chunks.astype(chunks.dtype.newbyteorder("<")), np.packbits(more, bitorder="little"), ranks]
    sizes = np.array([x.nbytes for x in sections])
    body = b"".join(x.tobytes() for x in sections)
    checks = [zlib.crc32(memoryview(body)[at : at + PAGE]) for at in range(0, len(body), PAGE)]
    places = np.stack([np.cumsum(sizes) - sizes, sizes], 1).astype("<u8")
    head = struct.pack("<IIQQQ", width, len(levels), len(ids), len(doc_ids), len(body)) + places.tobytes() + np.array(checks, "<u4").tobytes()
    return MAGIC + struct.pack("<QI", len(head), zlib.crc32(head)) + head + body


class DacFile:
    """A file in memory or a random-access one of pyarrow. Whatever is asked for, only the pages that hold it are read."""

    def __init__(self, source):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        start = self._take(0, len(MAGIC) + 12)
        size, check = struct.unpack_from("<QI", start, len(MAGIC)) if start[: len(MAGIC)] == MAGIC and len(start) == len(MAGIC) + 12 else (0, 1)
        head = self._take(len(start), size)
        if zlib.crc32(head) != check:
            raise ValueError("not a token file, or damaged")
        self.width, n_levels, self.n_tokens, self.n_docs, self.size = struct.unpack_from("<IIQQQ", head)
        n = 2 + 3 * n_levels
        self.sections = np.frombuffer(head, "<u8", 2 * n, 32).reshape(n, 2).astype(np.int64)
        self.checks = np.frombuffer(head, "<u4", -1, 32 + 16 * n)
        self.body, self.pages = len(start) + size, {}
        self.kind = np.dtype("u1" if self.width <= 8 else "<u2")

    def _take(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _page(self, i: int) -> bytes:
        if i not in self.pages:
            page = self._take(self.body + i * PAGE, min(PAGE, self.size - i * PAGE))
            if zlib.crc32(page) != self.checks[i]:
                raise ValueError("damaged token file")
            if len(self.pages) >= PAGES:
                self.pages.pop(next(iter(self.pages)))
            self.pages[i] = page
        return self.pages[i]

    def _items(self, section: int, kind: str | np.dtype, first: int, end: int) -> np.ndarray:
        """Items first to end of a section."""
        size = np.dtype(kind).itemsize
        at, stop = (int(self.sections[section, 0]) + x * size for x in (first, end))
        if at >= stop:
            return np.zeros(0, kind)
        pages = [self._page(i) for i in range(at // PAGE, (stop - 1) // PAGE + 1)]
        return np.frombuffer(b"".join(pages), kind, end - first, at % PAGE)

    def _bits(self, level: int, first: int, end: int) -> np.ndarray:
        """Continuation flags first to end of a level."""
        some = self._items(3 + 3 * level, "u1", first // 8, (end + 7) // 8)
        return np.unpackbits(some, bitorder="little")[first % 8 : first % 8 + end - first].view(bool)

    def _rank(self, level: int, i: int) -> int:
        """Set flags of a level before i: the rank directory's, and those of the block."""
        block = i // BLOCK
        return int(self._items(4 + 3 * level, "<i8", block, block + 1)[0]) + int(self._bits(level, block * BLOCK, i).sum())

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        return int(self.run(i, i + 1)[0])

    def run(self, first: int, end: int) -> np.ndarray:
        """Tokens first to end: at each level those that go on lie side by side, from the rank of the first."""
        out, places = np.zeros(end - first, np.uint32), np.arange(end - first)
        for level in range((len(self.sections) - 2) // 3):
            out[places] |= self._items(2 + 3 * level, self.kind, first, end).astype(np.uint32) << np.uint32(self.width * level)
            more = self._bits(level, first, end)
            places = places[more]
            if not len(places):
                break
            first = self._rank(level, first)
            end = first + len(places)
        return out

    def tokens(self) -> np.ndarray:
        """All tokens."""
        return self.run(0, self.n_tokens)

    def documents(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Doc_ids of documents first to end, and where each begins and the last one ends among the tokens."""
        firsts = self._items(1, "<i8", first, min(end + 1, self.n_docs))
        return self._items(0, "<i8", first, end), firsts if end < self.n_docs else np.append(firsts, self.n_tokens)


LETTER, MARK, APOSTROPHE = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(MARKS)] = MARK
_CLASS[ord("'")] = APOSTROPHE
_CLASS[ord("a") : ord("z") + 1] = LETTER


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of lower-cased texts, and pieces before each row.

    Cuts: ASCII white space, and between Latin letters (to U+00FF) and ASCII marks, but for letters after an apostrophe.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    inside = ~arrays.SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    left, right = kind[:-1], kind[1:]
    edge[1:-1] = (inside[1:] != inside[:-1]) | ((left == LETTER) & (right >= MARK)) | ((left == MARK) & (right == LETTER))
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = inside[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, offsets)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    The vocabulary lower-cases, and its normaliser and pre-tokeniser never join across the places where `cut_words`
    cuts. So a text's ids are those of its lower-cased pieces in order. A text in which a special token could appear
    goes to the library whole. Pieces are remembered in a hash table of arrays, by a 64-bit hash and their first eight
    bytes; when it is full, what is new is encoded for its batch alone.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values())
        if self.library.normalizer is None or self.library.normalizer.normalize_str("A") != "a":
            raise ValueError("only vocabularies that lower-case")
        self.keys, self.heads, self.entries = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Entry of each piece, or -1."""
        out = np.full(len(keys), -1, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        todo, slot = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            good = hit & (self.heads[slot] == heads[todo])
            out[todo[good]] = self.entries[slot[good]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & int(mask)
        return out

    def _keep(self, keys: np.ndarray, heads: np.ndarray, first_entry: int) -> None:
        mask = len(self.keys) - 1
        todo, slot = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            at = slot[put]
            self.keys[at], self.heads[at], self.entries[at] = keys[todo[put]], heads[todo[put]], first_entry + todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & mask

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has."""
        raw, data = data, arrays.lowered(data)
        starts, ends, words = cut_words(data, offsets)
        keys = np.maximum(arrays.span_hashes(data, starts, ends), np.uint64(1))
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        heads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[starts]
        short = np.minimum(ends - starts, 8).astype(np.uint64)
        heads = heads & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - short) << np.uint64(3)))
        entry = self._find(keys, heads)
        first, size, pool = self.first, self.size, self.pool
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            # equal keys with other heads are told apart
            order = missing[np.lexsort((heads[missing], keys[missing]))]
            new = np.ones(len(order), bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (heads[order][1:] != heads[order][:-1])
            entry[order] = len(first) + np.cumsum(new) - 1
            order = order[new]
            blob, a, b = data.tobytes(), starts[order].tolist(), ends[order].tolist()
            ids = self._library([blob[i:j].decode() for i, j in zip(a, b, strict=True)])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            first = np.concatenate([first, len(pool) + np.cumsum(sizes, dtype=np.int32) - sizes])
            size = np.concatenate([size, sizes])
            pool = np.concatenate([pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            alone = np.ones(len(order), bool)
            alone[1:] = keys[order][1:] != keys[order][:-1]
            if len(first) <= len(self.keys) // 2 and alone.all():
                self._keep(keys[order], heads[order], len(self.first))
                self.first, self.size, self.pool = first, size, pool
        many = size[entry]
        done = np.concatenate([[0], np.cumsum(many)])
        flat = pool[np.arange(done[-1]) - np.repeat(done[:-1] - first[entry], many)]
        counts = np.diff(done[words])
        text = data.tobytes()
        if any(x in text for x in self.special):
            flat, counts = self._with_special(raw, offsets, flat, counts)
        return flat, counts

    def _with_special(self, raw, offsets, flat, counts):
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for i in range(len(counts)):
            text = raw[offsets[i] : offsets[i + 1]].tobytes()
            if any(x in text.lower() for x in self.special):
                parts[i] = np.array(self._library([text.decode()])[0], np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for _, _, data, offsets in arrays.text_slices(pa.array(texts, pa.string())):
            flat, counts = self.encode_bytes(data, offsets)
            out += [p.astype("<u4").tobytes() for p in np.split(flat, np.cumsum(counts)[:-1])]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(documents: DataFrame, folder: str, vocabulary: str, end_id: int = 1, width: int = 8) -> DataFrame:
    """Writes <folder>/*.dac in ascending doc_id order; returns the manifest (file, part, seq, n_docs, n_tokens).

    The sort is a range partitioning, whose bounds come from a sample of the keys; each partition becomes one
    file or more of bounded size.
    """
    ship_package(documents.sparkSession)

    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, keys, lengths, total = [], [], [], 0

        def close():
            sizes = np.concatenate(lengths)
            with storage.new_file(folder, f"{part:06d}-{seq:04d}", ".dac") as (out, uri):
                out.write(pack(np.concatenate(ids), np.concatenate(keys), np.cumsum(sizes) - sizes, width))
            return pa.RecordBatch.from_pydict({"file": [uri], "part": [part], "seq": [seq], "n_docs": [len(sizes)], "n_tokens": [total]})

        for batch in batches:
            doc_id = batch.column(0).fill_null(NULL_ID).to_numpy()
            for first, end, data, offsets in arrays.text_slices(batch.column(1), 1 << 20):
                flat, counts = encoder(vocabulary).encode_bytes(data, offsets)
                some = np.full(len(flat) + len(counts), end_id, np.uint32)
                inner = np.ones(len(some), bool)
                inner[np.cumsum(counts + 1) - 1] = False
                some[inner] = flat
                ids.append(some)
                keys.append(doc_id[first:end])
                lengths.append(counts + 1)
                total += len(some)
                if total >= ROLL_TOKENS:
                    yield close()
                    seq += 1
                    ids, keys, lengths, total = [], [], [], 0
        if keys:
            yield close()

    rows = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "file string, part long, seq long, n_docs long, n_tokens long"
    return written(rows, arrays.tidied(write), schema, "dac-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds `base`, the tokens in all files before: sums of the parts, then sums within a part."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return manifest.join(parts, "part").select("file", "n_docs", "n_tokens", (F.col("part_base") + own).alias("base"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row for each document of the files: doc_id, start over all files, n_tokens, ids (little-endian, 32 bits)."""
    ship_package(manifest.sparkSession)
    n = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.read_file(uri) as source:
                    file = DacFile(source)
                    for at in range(0, file.n_docs, 500):
                        keys, firsts = file.documents(at, min(at + 500, file.n_docs))
                        tokens = file.run(int(firsts[0]), int(firsts[-1]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64(), mask=keys == NULL_ID), pa.array(firsts[:-1] + base, pa.int64()), pa.array(np.diff(firsts), pa.int64()), arrays.binary_column(tokens.astype("<u4"), np.diff(firsts))],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    return with_starts(manifest).select("file", "base").repartition(min(n, 4096)).mapInArrow(arrays.tidied(read), "doc_id long, start long, n_tokens long, ids binary")


def tokenize(documents: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Encode to files in the shared folder and read them back."""
    return read_tokens(write_tokens(documents, shared_dir(documents.sparkSession, "tokens"), vocabulary, end_id))
