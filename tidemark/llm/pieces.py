"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes U+2581 in front, with spaces as U+2581. Since no piece holds a U+2581 after another character, and
none holds a line end, merges never reach across such places: the text is cut there and each distinct chunk is
merged once, from a score-ordered agenda of adjacent symbol pairs (ties: leftmost). Symbols that are no piece fall back to their bytes. In each Arrow batch, the chunks that are new to the worker
and one whole text are also encoded by the sentencepiece library; a difference ends the job.

Cases: a null text is an empty one: begin and end id only, decoding to the empty text. Repeated and null doc_ids
and further columns pass through. Long chunks cost n log n.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import arrays
from tidemark.session import ship_package

SPACE = "▁"
#: Chunks a worker remembers the ids of.
CACHE_CHUNKS = 500_000
#: Longer chunks have an agenda of their own, a heap.
LONG_CHUNK = 64
NO_RANK = 1 << 40
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Remembered(dict):
    """Ids by chunk; `spare` has those of the current batch that there is no more room for."""

    spare: dict = {}

    def __missing__(self, chunk):
        return self.spare[chunk]


class PairTable:
    """Ranks and results of all pairs of pieces that make a piece, found by array.

    A few hash tables: what finds its place taken in one lies in the next.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        order = {p: rank for rank, p in enumerate(sorted(ids, key=lambda p: -scores[p]))}
        rows = [(ids[p[:i]] << 32 | ids[p[i:]], order[p], ids[p]) for p in ids for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        keys, ranks, joined = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.tables, bits = [], len(keys).bit_length() + 3
        while len(keys):
            slot = self._slot(keys, len(self.tables), bits)
            _, first = np.unique(slot, return_index=True)
            table = np.full((3, 1 << bits), -1, np.int64)
            table[:, slot[first]] = keys[first], ranks[first], joined[first]
            self.tables.append((bits, table))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, joined = keys[rest], ranks[rest], joined[rest]
            bits = max(len(keys).bit_length() + 3, 4)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        mixed = (keys.view(np.uint64) ^ (keys.view(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NO_RANK, joined piece) of each pair."""
        keys = left << 32 | right
        ranks, joined = np.full(len(keys), NO_RANK, np.int64), np.zeros(len(keys), np.int64)
        for level, (bits, table) in enumerate(self.tables):
            slot = self._slot(keys, level, bits)
            hit = table[0][slot] == keys
            ranks[hit], joined[hit] = table[1][slot[hit]], table[2][slot[hit]]
        return ranks, joined


class MergeModel:
    """A BPE model file of the sentencepiece library, with its own encoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (library.is_unknown, library.is_control, library.is_byte, library.is_unused)
        ids = [i for i in range(library.get_piece_size()) if not any(f(i) for f in special)]
        self.ids = {library.id_to_piece(i): i for i in ids}
        self.scores = {library.id_to_piece(i): library.get_score(i) for i in ids}
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("the vocabulary has pieces across white space")
        if any(library.is_unused(i) for i in range(library.get_piece_size())) or min(self.bytes) == library.unk_id():
            raise ValueError("only vocabularies with byte fallback and without unused pieces")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (library.bos_id(), library.eos_id()))
        self.known = Remembered()
        self.pairs = PairTable(self.ids, self.scores)
        self.point_ids = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.point_ids[ord(piece)] = i

    def merge(self, chunk: str) -> list[str]:
        """The pieces of a chunk: the best-scored adjacent pair is joined until no pair is a piece."""
        score = self.scores.get
        symbols = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            joined = chunk[i : i + 2]
            if (s := score(joined)) is not None:
                agenda.append((-s, i, i + 1, joined))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != len(joined):
                continue
            symbols[left], symbols[right] = joined, ""
            end = after[left] = after[right]
            if end < n:
                before[end] = left
                pair = joined + symbols[end]
                if (s := score(pair)) is not None:
                    heapq.heappush(agenda, (-s, left, end, pair))
            start = before[left]
            if start >= 0:
                pair = symbols[start] + joined
                if (s := score(pair)) is not None:
                    heapq.heappush(agenda, (-s, start, left, pair))
        return [s for s in symbols if s]

    def _ids_of(self, chunk: str) -> bytes:
        out = []
        for piece in self.merge(chunk):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in piece.encode()]
        return np.array(out, "<u4").tobytes()

    def merge_many(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of many chunks at once; None for a chunk with a character that is no piece.

        The agendas of all chunks lie in one array, the rank of each symbol's pair with its right neighbour. A
        round joins the best pair of every chunk, the leftmost of equal ones.
        """
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        chunk_of = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        symbols = self.point_ids[points]
        strange = np.bincount(chunk_of, symbols < 0, len(chunks)) > 0
        fine = ~strange[chunk_of]
        symbols, chunk_of = symbols[fine].astype(np.int64), chunk_of[fine]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks, joined = self.pairs.find(symbols[:-1], symbols[1:])
        ranks, joined = np.append(ranks, NO_RANK), np.append(joined, 0)
        ranks[:-1][chunk_of[:-1] != chunk_of[1:]] = NO_RANK
        while len(symbols):
            starts = np.flatnonzero(np.diff(chunk_of, prepend=-1))
            sizes = np.diff(starts, append=len(symbols))
            best = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            ended = best == NO_RANK
            if ended.any():
                done.append((chunk_of[ended], symbols[ended]))
            hits = np.flatnonzero((ranks == best) & ~ended)
            hits = hits[np.diff(chunk_of[hits], prepend=-1) > 0]
            symbols[hits] = joined[hits]
            keep = ~ended
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            symbols, chunk_of, ranks, joined = symbols[keep], chunk_of[keep], ranks[keep], joined[keep]
            if not len(symbols):
                break
            hits = place[hits]
            stale = np.concatenate([hits, hits[hits > 0] - 1])
            right = np.minimum(stale + 1, len(symbols) - 1)
            fresh, new = self.pairs.find(symbols[stale], symbols[right])
            fresh[(right == stale) | (chunk_of[right] != chunk_of[stale])] = NO_RANK
            ranks[stale], joined[stale] = fresh, new
        out: list[bytes | None] = [None] * len(chunks)
        if done:
            chunk_of = np.concatenate([c for c, _ in done])
            order = np.argsort(chunk_of, kind="stable")
            blob = np.concatenate([x for _, x in done])[order].astype("<u4").tobytes()
            ends = (np.cumsum(np.bincount(chunk_of, minlength=len(chunks))) * 4).tolist()
            start = 0
            for i, end in enumerate(ends):
                if end > start:
                    out[i] = blob[start:end]
                start = end
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the worker does not know; compared with the library's."""
        short = [c for c in chunks if len(c) <= LONG_CHUNK]
        ids = dict(zip(short, self.merge_many(short), strict=True)) if short else {}
        found = {c: ids.get(c) or self._ids_of(c) for c in chunks}
        # the library puts a U+2581 in front of a text; with a line end after it, it stays apart from the chunk
        theirs = self.library.encode(["\n" + c for c in chunks], num_threads=1)
        theirs = list(chain.from_iterable(x[2:] for x in theirs))
        if np.array(theirs, "<u4").tobytes() != b"".join(found.values()):
            raise ValueError("the library encodes a chunk otherwise")
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with begin and end ids."""
        split = [_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        new = self._learn(list({c for chunks in split for c in chunks if c not in known}))
        known.spare = new
        if len(known) + len(new) <= CACHE_CHUNKS:
            known.update(new)
        get = known.__getitem__
        out = [b"".join([self.begin, *map(get, chunks), self.end]) for chunks in split]
        for text, ids in list(zip(texts, out, strict=True))[:1]:
            if self.library.encode(text or "", add_bos=True, add_eos=True) != np.frombuffer(ids, "<u4").tolist():
                raise ValueError("the library encodes a text otherwise")
        return out

    def forget(self) -> None:
        """Chunks are remembered for one task: workers go on to other work."""
        self.known = Remembered()

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts, by the library's decode(ids)."""
        decode = self.library.decode
        return [decode(np.frombuffer(one, "<u4").tolist()) for one in ids]


_MODELS: dict[str, MergeModel] = {}


def model(path: str) -> MergeModel:
    """One model for each worker and file."""
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode_decode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (little-endian, 32 bits, with begin and end) and the text decoded from them; no shuffle."""
    ship_package(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids = model(vocabulary).encode(some.column(1).to_pylist())
                texts = model(vocabulary).decode(ids)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        model(vocabulary).forget()

    return documents.select("doc_id", "text").mapInArrow(arrays.tidied(run), "doc_id long, ids binary, decoded string")
