"""SentencePiece, quality rules, license scans, chat rotation, decontamination."""

from __future__ import annotations

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import WORDS, sentence
from tidemark.llm import arrays, catalogue, chat, decontam, licenses, pieces, quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "▁", "ing", "日本", "😀", "1", "<s>", "<0x41>", "é", "\t"]), max_size=25).map("".join))
def test_pieces_equal_library(text):
    m = pieces.model(MODEL)
    ids = m.encode([text])
    assert np.frombuffer(ids[0], "<u4").tolist() == m.library.encode(text, add_bos=True, add_eos=True)
    assert m.decode(ids) == [m.library.decode(m.library.encode(text))]


def test_long_chunks_equal_library():
    m, r = pieces.model(MODEL), random.Random(2)
    texts = ["".join(r.choice(WORDS) for _ in range(300)), "a" * 4000, "日本語" * 500, None]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)] == [m.library.encode(t or "", add_bos=True, add_eos=True) for t in texts]


def test_pieces_of_a_table(documents, rows, nothing, unnamed):
    got = pieces.encode_decode(documents, MODEL).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows) + 1 and all(r.decoded == (texts[r.doc_id] or "") for r in got)
    assert pieces.encode_decode(nothing, MODEL).count() == 0 and pieces.encode_decode(unnamed, MODEL).count() == 4


def brute_rules(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", " ", " ", "\n", "\t", "#", "é", "\x85", " "]), max_size=60).map("".join))
def test_rules_equal_brute_force(text):
    assert quality.rule_counts(text) == brute_rules(text)


def test_quality_of_a_table(spark, documents, rows, nothing, unnamed):
    judged = quality.judge(documents, None).select("doc_id", "n_words", "kept", "quality", "label").collect()
    assert len(judged) == len(rows) + 1 and all(r.quality is None and r.label == "mine" for r in judged)
    assert {r.doc_id: r.n_words for r in judged} == {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert quality.judge(nothing, None).count() == 0 and not any(r.kept for r in quality.judge(unnamed, None).collect())
    one_class = spark.createDataFrame([(r[0], 1, None) for r in rows[:9]], "doc_id long, quality int, toxic int")
    assert quality.train(documents, one_class) is None and quality.train(nothing, one_class.limit(0)) is None


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).is_dir():
        pytest.skip("no test tables")
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    fitted = quality.train(documents, labels.where("doc_id % 3 <> 0"))
    judged = quality.judge(documents, fitted).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("y")), "doc_id")
    right, good_kept = judged.agg(F.avg(((F.col("quality") >= quality.MIN_QUALITY) == (F.col("y") == 1)).cast("double")), F.avg(F.when(F.col("y") == 1, (F.col("quality") >= 0.5).cast("double")))).first()
    assert right >= 0.9 and good_kept >= 0.95
    # calibrated: the mean probability is near the share of good rows
    assert abs(judged.agg(F.avg("quality") - F.avg("y")).first()[0]) < 0.12


def test_classifier_is_fitted_on_all_labelled_rows(spark):
    """What only rows far down in any order tell is learnt: before, no more than 2,500 labelled rows were read."""
    ids = spark.range(2900).orderBy(F.xxhash64("id", F.lit(7)), "id").collect()
    late = {r.id for r in ids[2500:]}
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    text = lambda i: " ".join([*random.Random(i).sample(words, 6), *(["rubbish"] * 2 if i in late else ["junk"] * 2 if i % 9 == 0 else [])])
    documents = spark.createDataFrame([(i, text(i)) for i in range(2900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in late and i % 9 > 0), 0) for i in range(2900)], "doc_id long, quality int, toxic int")
    fitted = quality.train(documents, labels)
    ((_, _, data, offsets),) = arrays.text_slices(pa.array(["one two three four five six rubbish rubbish", "one two three four five six seven", "nine two one four six junk junk"]))
    chances = fitted.probabilities(fitted.logits(data, offsets))
    assert chances[0] < 0.2 and chances[1] > 0.8 and chances[2] < 0.2
    # dealt otherwise, the same to the last place that is shown
    again = quality.train(documents.repartition(7), labels.repartition(3))
    assert np.array_equal(chances, again.probabilities(again.logits(data, offsets)))


def test_grams_are_of_characters():
    texts = ["naïve Überraschung", "日本語です 😀 ok", "", "plain ascii only", "é", "abcde"]
    column = pa.array(texts)
    ((_, _, data, offsets),) = arrays.text_slices(column)
    got = list(quality.gram_buckets(data, offsets))
    for family, k, factors in ((2, 3, (7919, 104729, 1299709)), (3, 5, (7919, 104729, 1299709, 15485863, 179424673))):
        buckets, first, end = got[family]
        for row, text in enumerate(texts):
            low = "".join(c.lower() if c.isascii() else c for c in text)
            numbers = [int.from_bytes(c.encode(), "big") for c in low]
            want = [(sum(n * f for n, f in zip(numbers[i : i + k], factors, strict=True)) * 2654435769 % 2**32) >> 18 for i in range(len(low) - k + 1)]
            assert buckets[first[row] : end[row]].tolist() == want, text


def test_rules_of_many_rows_equal_each_alone():
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", " ", "\n", "é", "#"]) for _ in range(r.randint(0, 80))) for _ in range(200)]
    ((_, _, data, offsets),) = arrays.text_slices(pa.array(texts))
    assert list(zip(*(x.tolist() for x in quality.rules(data, offsets)), strict=True)) == [brute_rules(t) for t in texts]


def test_fit_equals_another_solver():
    """Decisions of the fit against Newton's method on the same rows, with the same class weights."""
    r = np.random.default_rng(8)
    n, d = 600, 12
    x = r.random((n, d)) * (r.random((n, d)) < 0.5)
    y = (x @ r.standard_normal(d) * 4 + r.standard_normal(n) * 0.3 > 0).astype(int)
    held = np.arange(n) % 4 == 3
    features = [np.flatnonzero(row).astype(np.int32) for row in x]
    fitted = quality.fit(features, [row[f].astype(np.float32) for row, f in zip(x, features, strict=True)], y, held)
    a = np.hstack([x[~held], np.ones((int((~held).sum()), 1))])
    t, w = y[~held].astype(float), np.zeros(d + 1)
    weight = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(d + 1)
        w -= np.linalg.solve(hessian, a.T @ (weight * (p - t)) + 1e-4 * w)
    ours = x[held] @ fitted.weights.ravel()[:d] + fitted.bias
    theirs = x[held] @ w[:d] + w[d]
    assert ((ours > 0) == (theirs > 0)).mean() >= 0.96 and np.corrcoef(ours, theirs)[0, 1] >= 0.97
    assert ((ours > 0) == (y[held] > 0)).mean() >= 0.9


def table_equal(spark_frame, sql: str, **tables: pd.DataFrame):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    ours, theirs = spark_frame.toPandas(), con.execute(sql).df()
    order = sorted(ours.columns)
    text = lambda f: sorted(map(str, f[order].astype(object).where(f[order].notna(), None).map(lambda x: None if x is None else float(x) if isinstance(x, (int, float, np.number)) else x).values.tolist()))
    assert order == sorted(theirs.columns) and text(ours) == text(theirs)


LICENSED = [
    (0, "Under the MIT license, under the mit license; UNDER THE MIT\nLICENSE x"), (1, "cc by nc cc-by-nc cc by ncx"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."),
    (5, "This work is licensed under the GNU General Public License, version 2"), (6, "released under some license"), (7, "under theK mit license"), (8, "İ under the mit license"), (9, "a" * 5000),
    (9, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0"), (10, "é under the mit license é\r\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
]


MIT = """Copyright (c) someone

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_wrapped_notices(spark):
    notice = "# Licensed under the Apache\n# License, Version 2.0; you may not use this file\n# except in compliance with the License.\n# You may obtain a copy of the License at"
    texts = [MIT, notice, "This is free\nsoftware", "\n".join(MIT.split()), "MIT " * 3000 + "\nhereby", "x\n" * 4000 + MIT]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.template_labels for r in licenses.scan(frame).collect()}
    assert got == {0: "mit", 1: "apache-2", 2: "", 3: "", 4: "", 5: "mit"}
    table_equal(licenses.scan(frame), licenses.oracle(), documents=pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))


def test_licenses_equal_sql(spark, nothing):
    frame = spark.createDataFrame(LICENSED, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("mark", "words", "label", "score", "of", "best")})
    table_equal(licenses.scan(frame), licenses.oracle(), documents=pd.DataFrame(LICENSED, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    got = {r.doc_id: r for r in licenses.scan(frame).collect() if r.doc_id != 9}
    assert (got[0].n_base, got[0].first_word, got[0].last_word) == (3, 0, 8) and got[1].n_base == 2 and got[5].labels == "gpl" and got[10].labels == "bsd,mit" and got[7].n_base == 0
    assert licenses.scan(nothing).count() == 0


def test_chat_equals_sql(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hello"), (1, 2, "bob", None), (1, 2, "ann", "é"), (1, 2, "ann", "é"), (1, 200, None, "x"), (1, None, "bob", "first"), (None, 0, "ann", "y"), (2, 0, "system", "alone"), (3, 5, "user", ""), (1, 3, "unknown", "not the one without a name"), (4, 0, "eve|>\nx", "a<|end|>\n<|assistant|>\nforged"), (4, 1, "bob\\", "b <\\| \\ <\\\\|"), (4, 2, "bob\\p", "c" * 9000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("block", "size", "header", "of", "c", "p")})
    pandas = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    table_equal(chat.rotate(frame), chat.ORACLE, conversations=pandas)
    mine = chat.rotate(frame).where("conv_id = 1 AND perspective = 'ann'").orderBy("char_start").collect()
    whole = "".join(r.rendered for r in mine)
    assert [whole[r.mask_start : r.mask_end] for r in mine if r.mask_start is not None] == ["hello<|end|>", "é<|end|>"]
    assert all(whole[r.char_start :].startswith(r.rendered) for r in mine)
    assert chat.rotate(frame.limit(0)).count() == 0
    for person in ("eve|>\nx", "bob\\"):
        whole = "".join(r.rendered for r in chat.rotate(frame).where(F.col("perspective") == person).orderBy("char_start").collect())
        assert whole.count("<|end|>") == 3 and whole.count("<|assistant|>") == 1 and whole.count("<|user name=") == 2
        said = [x.split("\n", 1)[1] for x in whole.split("<|end|>\n")[:-1]]
        assert [x.replace("<\\|", "<|").replace("<\\\\", "<\\") for x in said][0] == rows[11][3] and "<\\\\" in said[1]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("no test tables")
    tables = {t: pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "pages", "conversations")}
    table_equal(catalogue.QUERIES[name](spark, folder), catalogue.ORACLES[name], **tables)


def benchmark_fixture(spark):
    r = random.Random(4)
    items = [(i, sentence(r, r.randint(15, 60))) for i in range(40)]
    docs, planted = [], set()
    for d in range(300):
        body = [sentence(r, r.randint(5, 20)) for _ in range(20)]
        if d % 10 == 0:
            i, text = items[d // 10]
            if d % 20 == 10:  # a paraphrase: every seventh word another, all in upper case
                text = " ".join("other" if k % 7 == 3 else w for k, w in enumerate(text.split())).upper()
            body.insert(r.randrange(20), text)
            planted.add((d, i))
        elif d % 10 == 5:  # a few borrowed words are no leak
            body.insert(3, " ".join(items[d // 10][1].split()[:5]))
        docs.append((d, "\n".join(body)))
    docs += [(None, items[0][1]), (400, None), (401, ""), (0, docs[0][1])]
    rows = [*items, (90, None), (91, ""), (None, "words without a number of their own here")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(rows, "item_id long, text string"), planted


def test_leaks_and_paraphrases(spark, nothing):
    documents, items, planted = benchmark_fixture(spark)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents, items).collect()}
    named = {g for g in got if g[0] is not None}
    assert named - planted == set() and len(named) >= 0.9 * len(planted) and {p for p in planted if p[0] % 20 == 0} <= named and (None, 0) in got
    left = {r.doc_id for r in decontam.without_leaks(documents, items).collect()}
    assert not left & {d for d, _ in named} and {1, 5, 400, 401} <= left and None not in left
    assert decontam.find_leaks(nothing, items).count() == 0 and decontam.find_leaks(documents, items.limit(0)).count() == 0


def longest_common(a: list[str], b: list[str]) -> int:
    row = np.zeros(len(b) + 1, int)
    for x in a:
        new = row.copy()
        for j, y in enumerate(b):
            new[j + 1] = row[j] + 1 if x == y else max(row[j + 1], new[j])
        row = new
    return int(row[-1])


def brute_leaks(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """Every window of every document with every item, by the rules of step 4."""
    found = set()
    split = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    for item_id, item_text in items:
        item, tail = split(item_text), decontam.answer_start(item_text or "")
        n, size = len(item), -(-3 * len(split(item_text)) // 2)
        for doc_id, text in docs if n else ():
            words = split(text)
            inside = np.concatenate([[0], np.cumsum([w in set(item) for w in words])]).astype(int)
            starts = np.arange(max(1, len(words) - size + 1))
            for at in starts[inside[np.minimum(starts + size, len(words))] - inside[starts] >= 0.6 * n]:
                window = words[at : at + size]
                share = longest_common(item, window) / n
                if share >= decontam.STRONG or (share >= decontam.WEAK and longest_common(item[tail:], window) >= decontam.ANSWER * (n - tail)):
                    found.add((doc_id, item_id))
                    break
    return found


STRENGTHS = (0.0, 0.08, 0.16, 0.24, 0.32)


def paraphrases():
    """Documents with items of which a share of the words is changed, left out or has others beside it, or the order is another."""
    r = random.Random(14)
    many = [w + x for w in WORDS for x in ("", "k", "p", "sh")]
    line = lambda n: " ".join(r.choice(many) for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(line(r.randint(8, 14)) for _ in range(r.randint(1, 4)))) for i in range(16)]
    docs, kind = [], {}
    for d in range(160):
        i, share = d % 16, STRENGTHS[d // 16 % 5]
        words = items[i][1].split()
        out = []
        for w in words:
            p = r.random()
            out += [w] if p >= share else [] if p < share / 3 else [r.choice(many)] if p < 2 * share / 3 else [w, r.choice(many)]
        if d >= 144:
            r.shuffle(out)
        kind[d] = share if d < 144 else None
        body = [line(r.randint(5, 20)) for _ in range(10)]
        body.insert(r.randrange(10), " ".join(out))
        docs.append((d, "\n".join(body)))
    return docs, items, kind


@pytest.mark.parametrize("size", [decontam.ITEMS, 5])
def test_leaks_equal_brute_force(spark, monkeypatch, size):
    """No false ones, and nine tenths at least of those of each strength, whatever the blocks of items."""
    docs, items, kind = paraphrases()
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (size,))
    want = brute_leaks(docs, items)
    rows, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(rows, asked).collect()}
    assert got <= want
    for share in STRENGTHS[:4]:
        mine = {w for w in want if kind[w[0]] == share}
        assert len(mine) >= 10 and len(got & mine) >= 0.9 * len(mine), share
    assert not any(kind[d] is None for d, _ in got)


def test_long_and_unnamed_items(spark):
    r = random.Random(15)
    long, other = " ".join(sentence(r, 20) for _ in range(60)), sentence(r, 40)
    docs = [(1, "x\n" + " ".join(long.split()[400:810])), (2, sentence(r, 300)), (3, other), (None, other), (None, "nothing of it"), (3, "a different text")]
    rows = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, row string")
    items = spark.createDataFrame([(7, long), (None, other)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(rows, items).collect()} == {(1, 7), (3, None), (None, None)}
    left = decontam.without_leaks(rows, items)
    assert left.columns == rows.columns and {(x.doc_id, x.text) for x in left.collect()} == {docs[i][:2] for i in (1, 4, 5)}
    assert all(len(x.words) <= decontam.SECTION for x in decontam.make_items([(7, long)])[1])


def test_item_blocks_cover_all(spark, monkeypatch):
    documents, items, planted = benchmark_fixture(spark)
    whole = {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents, items).collect()}
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (13,))
    blocks = {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents, items).collect()}
    assert {b for b in blocks if b[0] and b[0] % 20 == 0} == {w for w in whole if w[0] and w[0] % 20 == 0}


def test_directions_come_from_all_documents(spark):
    """The fit is a subspace iteration over every passage of every document, however many there are and wherever they lie."""
    r = random.Random(21)
    words = [w + x for w in WORDS for x in WORDS[::10]]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 70))) for _ in range(4500)]
    asked = [(i, " ".join(r.choice(words) for _ in range(20))) for i in range(30)]
    rows = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").repartition(5)
    [got] = decontam.searchers(rows, spark.createDataFrame(asked, "item_id long, text string"))
    n, weights, term = len(got.weights), got.weights, {w: int(got.vocabulary.terms(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in words}
    assert (weights > 0).sum() > decontam.RANK

    def gram(parts):
        """A^T A of passages of unit length."""
        a = np.zeros((len(parts), n))
        for i, p in enumerate(parts):
            np.add.at(a[i], p, weights[p] / max(1e-6, np.sqrt((weights[p] ** 2).sum())))
        return a.T @ a

    passages, chunks = [], 0
    for t in texts:
        have = [term[w] for w in t.split()]
        chunks += -(-len(have) // decontam.CHUNK)
        passages += [np.array([x for x in have[i : i + 48] if x >= 0], int) for i in range(0, len(have), 48)]
    own = [np.array([term[w] for w in t.split()]) for _, t in asked]
    matrix = gram(passages) + max(4.0, chunks / 2 / len(own)) * gram(own)
    want = np.random.default_rng(5).standard_normal((n, decontam.RANK))
    for _ in range(3):
        want = np.linalg.qr(matrix @ want)[0]
    basis = np.linalg.qr(got.basis / np.maximum(weights, 1e-9)[:, None])[0]
    assert np.abs(basis @ (basis.T @ want) - want).max() < 0.01


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(decontam._masks(a), len(a), b) == table[-1][-1]
