"""WARC archives and token files."""

from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import dac, storage, warc

BPE = public_tokenizers.path("word_bpe_49k.json")
PAGES = "page_id long, url string, html string, digest string"


def test_archive_round_trip(spark):
    long = "ä" * 600
    pages = [(1, "http://a", long, "x"), (2, None, long, "x"), (3, "u", None, "x"), (4, "u", "short", "x"), (5, "u", "short", "x"), (None, "u", "n" * 2000, "x"), (9, "u\r\nX: y", long, "x")]
    got = {r.page_id: r for r in warc.archive(spark.createDataFrame(pages, PAGES)).collect()}
    for page_id, _, html, _ in pages:
        raw = (html or "").encode()
        assert got[page_id].payload_bytes == len(raw) and got[page_id].payload_digest == hashlib.sha1(raw).hexdigest()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if i in (1, 2, 9)} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None)}
    assert {got[i].record_type for i in (3, 4, 5, None)} == {"response"} and bytes(got[9].payload).decode() == long


def test_empty_archive(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_reader_finds_damage():
    record = warc.make_record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None, False)
    good = warc.gzip_member(record) * 2
    assert [warc.read_record(r)["payload"] for _, r in warc.members(io.BytesIO(good), 7)] == [b"body", b"body"]
    with pytest.raises(warc.WarcError, match="cut off"):
        list(warc.members(io.BytesIO(good[:-3])))
    with pytest.raises(warc.WarcError, match="digest"):
        warc.read_record(record.replace(b"body", b"bodz"))
    with pytest.raises(warc.WarcError, match="Content-Length"):
        warc.read_record(record + b"x")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.sampled_from([4, 8, 11, 16]))
def test_codes_give_every_token(ids, width):
    file = dac.DacFile(dac.pack(np.array(ids, np.uint32), np.array([7]), np.array([0]), width))
    assert (file.tokens().tolist() if ids else []) == ids
    for a in {0, len(ids) // 3, len(ids) // 2}:
        assert file.run(a, len(ids)).tolist() == ids[a:]
    for i in {0, 1, len(ids) // 2, len(ids) - 1, 511, 512, 513}:
        if 0 <= i < len(ids):
            assert file.token(i) == ids[i]
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_damaged_code_file():
    data = dac.pack(np.arange(9, dtype=np.uint32), np.array([1]), np.array([0]))
    for at in (3, 20, 40, len(data) - 1):
        with pytest.raises(ValueError, match="damaged"):
            broken = dac.DacFile(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
            broken.documents(0, 1), broken.tokens(), [broken._items(i, "u1", 0, int(n)) for i, (_, n) in enumerate(broken.sections)]
    with pytest.raises(ValueError, match="damaged"):
        dac.DacFile(data[:15])


class Counted(io.BytesIO):
    """A file that knows how much was read of it."""

    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


def test_one_token_needs_few_pages():
    ids = np.random.default_rng(2).integers(0, 49_000, 1_000_000).astype(np.uint32)
    data = dac.pack(ids, np.arange(10), np.arange(10) * 100_000)
    for i in (0, 123_456, 999_999):
        source = Counted(data)
        assert dac.DacFile(source).token(i) == ids[i] and source.bytes_read < len(data) / 4
    source = Counted(data)
    file = dac.DacFile(source)
    keys, firsts = file.documents(3, 5)
    assert keys.tolist() == [3, 4] and firsts.tolist() == [300_000, 400_000, 500_000] and (file.run(300_000, 500_000) == ids[300_000:500_000]).all()
    assert source.bytes_read < len(data) / 2 and file.documents(9, 10)[1].tolist() == [900_000, 1_000_000]


def test_token_files_equal_library(spark, documents, rows, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    monkeypatch.setattr(dac, "ROLL_TOKENS", 2000)
    start = 0
    got = dac.tokenize(documents, BPE).orderBy("start").collect()
    assert len(got) == len(rows) + 1
    texts = {r[0]: r[1] for r in rows}
    assert [r.doc_id for r in got] == sorted([*texts, rows[0][0]])
    for r in got:
        want = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens, ids) == (start, len(want), want)
        start += len(want)


def test_token_files_without_rows_or_ids(spark, nothing, unnamed):
    assert dac.tokenize(nothing, BPE).count() == 0
    got = dac.tokenize(unnamed, BPE).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, None, 4] and [r.n_tokens for r in got][:2] == [1, 1] and got[-1].n_tokens == 1


PARTS = st.sampled_from(["a", "b", "é", "×", "÷", "'s", "'", "l", "don't", ",", ".", "—", " ", "\n", "1", "٣", "é", "́", "ß", "Ω", "<|", "|>", "<|endoftext|>", "日", " ", "\x85", "_", "T", "É", "½", "the", "THE"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=20).map("".join))
def test_word_encoder_equals_library(text):
    encoder = dac.encoder(BPE)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_word_encoder_when_full(rows):
    small, texts = dac.WordEncoder(BPE, slots=64), [r[1] or "" for r in rows]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)] == [small.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_files_have_own_names(tmp_path):
    folder, uris = f"file://{tmp_path}/x", []
    for _ in range(2):
        with storage.new_file(folder, "0", ".bin") as (out, uri):
            out.write(zlib.compress(b"a"))
        uris.append(uri)
    assert len(set(uris)) == 2 and storage.read_file(uris[0]).read() == storage.read_stream(uris[1]).read()
