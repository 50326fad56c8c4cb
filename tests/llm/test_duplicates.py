"""Near-duplicates, line dedup, repeated strings, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, WORDS, document, edited, sentence
from tidemark.llm import dac, decontam, graph, lines, minhash, quality, repeats


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(texts: dict[int, str | None], percent: int = 85) -> dict[int, int]:
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def check_components(frame, texts):
    got = frame.collect()
    want = brute_components(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(texts[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_near_duplicates_equal_brute_force(documents, rows, nothing, unnamed):
    check_components(minhash.near_duplicates(documents), {r[0]: r[1] for r in rows})
    assert minhash.near_duplicates(nothing).count() == 0
    assert [r.kept for r in minhash.near_duplicates(unnamed).collect()] == [True] * 4


def test_crowded_buckets(spark, monkeypatch):
    """Many look-alikes just around the threshold, with small blocks."""
    r = random.Random(8)
    base = document(r, 8)
    texts = {i: edited(r, base, r.randint(0, 3)) for i in range(140)}
    for name, value in (("BLOCK", 32), ("FEW", 2), ("MEMBERS", 5), ("SHINGLES", 4000)):
        monkeypatch.setattr(minhash, name, value)
    check_components(minhash.near_duplicates(spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], SCHEMA)), texts)


def test_repeated_ids_join_their_texts(spark, monkeypatch):
    """Texts of one doc_id are one node, whatever the order of rows; rows of their own keep or lose each text."""
    r = random.Random(21)
    a, b = document(r, 8), document(r, 8)
    rows = [(1, a), (1, b), (2, edited(r, a, 1)), (3, edited(r, b, 1))]
    for order in (rows, rows[::-1], [rows[i] for i in (1, 3, 0, 2)]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(2)).collect()
        assert {(x.doc_id, x.component_id, x.kept) for x in got} == {(1, 1, True), (2, 1, False), (3, 1, False)} and len(got) == 4
        assert sum(x.text_kept for x in got) == 2 and all(x.text_kept == (x.doc_id == 1) for x in got)
    bases = [document(r, 6) for _ in range(12)]
    many = [(r.randrange(25), edited(r, r.choice(bases), r.randint(0, 4))) for _ in range(70)]
    root = {i: i for i, _ in many}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in many]
    for i, x in sets:
        for j, y in sets:
            if 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = minhash.near_duplicates(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert len(got) == len(many) and all((x.component_id, x.kept) == (find(x.doc_id), find(x.doc_id) == x.doc_id) for x in got)


def test_estimates_are_corrected():
    r = np.random.default_rng(3)
    for n in (200, 5000):
        for share in (0.0, 0.5, 0.85):
            found = []
            for _ in range(60):
                common = int(2 * n * share / (1 + share))
                both = r.integers(0, 2**64, common, dtype=np.uint64)
                sides = [np.sort(np.concatenate([both, r.integers(0, 2**64, n - common, dtype=np.uint64)])) for _ in range(2)]
                a, b = (minhash.registers(np.zeros(n, int), s, 1, minhash.FINE) for s in sides)
                found.append(minhash.estimates(a, b, np.array([n]))[0][0])
            assert abs(np.mean(found) - share) < 0.015


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)] + [(70, 60), (149, 99)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[70] == 0 and {got[i] for i in range(99, 150)} == {99}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(texts: dict[int, str | None]) -> dict[int, str | None]:
    earlier: list[frozenset] = []
    out: dict[int, str | None] = {}
    for i in sorted(texts):
        keep = []
        for line in [] if texts[i] is None else texts[i].split("\n"):
            words = frozenset(line.encode().lower().split())
            if words:
                if not any(10 * len(words & e) >= 9 * len(words | e) for e in earlier):
                    keep.append(line)
                earlier.append(words)
            else:
                keep.append(line)
        out[i] = None if texts[i] is None else "\n".join(keep)
    return out


@pytest.mark.parametrize("limits", [{}, {"FIRST": 1, "BLOCK": 3, "TOGETHER": 40, "COMMON": 2, "PAIRS": 7}, {"FIRST": 1, "BLOCK": 2, "COMMON": 10**6}])
def test_line_dedup_equals_brute_force(spark, documents, rows, nothing, unnamed, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lines, name, value)
    r = random.Random(5)
    more = [(1000 + i, edited(r, sentence(random.Random(7), 40), r.randint(0, 4)), "", "", 0) for i in range(40)]
    frame = documents.select(SCHEMA.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame(more, SCHEMA)).withColumn("n", F.lit(1))
    texts = {r[0]: r[1] for r in [*rows, *more]}
    want = brute_lines(texts)
    for r in lines.dedup_lines(frame).collect():
        assert r.text == want[r.doc_id] and r.n == 1
        assert r.n_lines - r.n_removed == (0 if r.text is None else r.text.count("\n") + 1 if r.n_lines > r.n_removed else 0)
    if not limits:
        assert lines.dedup_lines(nothing).count() == 0 and lines.dedup_lines(unnamed).count() == 4
        assert {r.lang for r in lines.dedup_lines(documents).collect()} == {"en"}


def test_short_lines_are_judged(spark):
    """Lines of one word and more, and sets around the smallest that can match without being equal."""
    r = random.Random(11)
    nine = [w + "x" for w in WORDS[:9]]
    texts = {0: "One\ntwo words\nA b c\na b c d\n\n" + " ".join(nine), 1: "one\nwords TWO two\n\nnew\nc b a\nd a b c\na b c e", 2: "one", 3: " ".join([*nine, "ten"])}
    texts |= {4: " ".join(nine[:8]), 5: " ".join([*nine[:8], "other"]), 6: " ".join(nine[::-1])}
    texts |= {10 + i: "\n".join(" ".join(r.choice("abcde") for _ in range(r.randint(0, 5))) for _ in range(12)) for i in range(30)}
    got = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], SCHEMA)).collect()}
    earlier, want = [], {}
    for i in sorted(texts):
        keep = []
        for line in texts[i].split("\n"):
            words = frozenset(line.lower().split())
            if not words or not any(10 * len(words & e) >= 9 * len(words | e) for e in earlier):
                keep.append(line)
            earlier += [words] if words else []
        want[i] = "\n".join(keep)
    assert got == want and got[1] == "\nnew\na b c e" and [got[i] for i in (2, 3, 6)] == [""] * 3 and got[4] and got[5]


def test_repeats_equal_brute_force(spark, documents, rows, nothing, unnamed):
    r = random.Random(9)
    passage = sentence(r, 60)
    more = [(2000 + i, sentence(r, 5) + passage[: r.randint(90, 130)] + sentence(r, 8) + passage, "", "", 0) for i in range(12)]
    more += [(3000, "ab" * 300, "", "", 0), (3001, "ba" * 200 + "ü" * 90, "", "", 0), (3002, "ü" * 120, "", "", 0), (3003, "q" * 99, "", "", 0), (3004, "q" * 99, "", "", 0), (3005, "q" * 101, "", "", 0)]
    base = documents.select(SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    frame = base.unionByName(spark.createDataFrame(more, SCHEMA))
    texts = {x[0]: (x[1] or "").encode() for x in [*rows, *more]}
    gone = repeats.brute_force(list(texts.items()))
    for hot in (repeats.HOT, 2):
        got = repeats.remove_repeats(frame, hot).collect()
        assert len(got) == len(texts) + 1
        for x in got:
            raw, g = texts[x.doc_id], gone[x.doc_id]
            spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
            assert (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) == (len(raw), int(g.sum()), spans, np.frombuffer(raw, np.uint8)[~g].tobytes()), x.doc_id
    assert repeats.remove_repeats(nothing).count() == 0 and [x.n_removed for x in repeats.remove_repeats(unnamed).collect()] == [0] * 4
    assert repeats.remove_repeats(documents).count() == len(rows) + 1


def test_every_window_has_its_trigger():
    text = ("abc" * 80 + "".join(chr(97 + i * i % 26) for i in range(500))).encode()
    place, _, lo, hi, _, _ = repeats.triggers(np.frombuffer(text, np.uint8), np.array([0, 130, len(text)]))
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert windows.tolist() == [*range(0, 31), *range(130, len(text) - 99)]
    assert ((place >= lo) & (place >= hi) & (place - lo <= repeats.REACH)).all()


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stage by stage on a small folder; the classifier's verdicts are taken from its operator."""
    r = random.Random(6)
    items = [(i, sentence(r, 25)) for i in range(5)]
    texts = {i: document(r, 8) for i in range(60)}
    texts |= {100 + i: texts[i] for i in range(5)} | {200 + i: edited(r, texts[20 + i].replace("\n", " "), 1) for i in range(5)}
    texts |= {300 + i: document(r, 4) + "\n" + items[i][1] + "\n" + document(r, 2) for i in range(3)} | {400: None, 401: "few words", 402: "spam spam spam spam spam " * 30}
    junk = {500 + i: " ".join(w + "***" for w in document(r, 5).split()) for i in range(30)}
    texts |= junk
    pa_rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(pa_rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in [*range(30), *junk]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    kept = {x.doc_id for x in quality.judge(documents, quality.train(documents, labels)).where("kept").collect()}
    assert not kept & {400, 401, 402} and len(kept & set(junk)) <= 3 and len(kept & set(range(60))) >= 57
    after = {i: t for i, t in brute_lines({i: texts[i] for i in kept}).items() if t.strip()}
    components = brute_components(after, corpus_pipeline.SIMILAR)
    after = {i: t for i, t in after.items() if components[i] == i}
    plain = lambda t: " ".join(t.lower().replace(".", " ").split())
    after = {i: t for i, t in after.items() if not any(plain(x) in plain(t) for _, x in items)}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = {i: hashlib.sha256(np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for i, t in after.items()}
    assert {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_copies_with_short_lines_leave_the_pipeline(spark):
    """A copy loses its lines of one to four words too, so nothing is left of it that near-dedup would not know."""
    r = random.Random(12)
    short = lambda i: "\n".join(" ".join(f"{w}{i}" for w in WORDS[:n]) for n in range(1, 5))
    texts = {i: f"{short(i)}\n{document(r, 3)}\n\nend of {i}" for i in range(8)}
    copies = {100 + i: texts[i] for i in texts} | {200: texts[0].upper(), 201: "\n".join(reversed(texts[1].split("\n")))}
    other = {300: short(2) + "\nonly here"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in {**texts, **copies, **other}.items()], SCHEMA)
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: (t, len(t)) for i, t in texts.items()} | {300: ("only here", 9)}


def test_stages_keep_columns(spark, tmp_path, rows, nothing):
    """Whatever columns there are, under any names and with nulls, rows that stay keep them; empty tables pass."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, rows[0][1] or "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [*rows[:30], rows[1], (rows[2][0], "another text of a doc_id " * 5, "en", "s", 3), (None, "one without a doc_id " * 9, "en", "s", 3), (None, None, None, None, None), (77, "", None, None, 0)]
    taken = ("n_words", "quality", "kept", "n_lines", "n_removed", "row", "mark", "of", "here", "id", "component_id", "item_id", "a.b")
    plain = spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], SCHEMA + ", number int")
    docs = plain.withColumns({c: F.when(F.col("number") % 2 == 0, F.concat(F.lit(c), F.col("number").cast("string"))) for c in taken}).withColumn("list", F.array("number"))
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        for frame in (docs, nothing):
            out = stage(spark, frame, str(tmp_path))
            assert last or (out.columns == frame.columns and [t for _, t in out.dtypes] == [t for _, t in frame.dtypes])
            got = out.collect()
            assert len(got) == 0 if frame is nothing else got
            if frame is docs and not last:
                assert len({r.number for r in got}) == len(got)
                for r in got:
                    assert [r[c] for c in taken] == [f"{c}{r.number}" if r.number % 2 == 0 else None for c in taken] and r.list == [r.number]
                    assert name == "line dedup" or r.text == texts[r.number][1]
                if name == "MinHash near-dedup":
                    assert {31, 32, 33, 34} <= {r.number for r in got}  # another text of a doc_id, and rows without one


def mark(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def test_repeated_ids_and_long_texts(spark):
    """Rows of one doc_id with several texts, repeated rows, and texts of many lines, of one long line and of one long word."""
    r = random.Random(31)
    long = "\n".join(sentence(r, r.randint(9, 14)) for _ in range(150))
    line = " ".join(f"{w}{i}" for i in range(60) for w in WORDS[:100])
    texts = [(1, document(r)), (1, document(r)), (1, long[2000:9000]), (2, long), (2, long), (3, long + "\nend"), (3, line), (4, line + " more"), (5, "x" * 30_000), (5, "x" * 30_001), (0, document(r) + "\n" + long.split("\n")[3])]
    texts.append(texts[0])
    frame = spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], "doc_id long, text string, number int").repartition(3)
    order = sorted({t for t in texts}, key=lambda t: (t[0], mark(t[1])))
    earlier, want = [], {}
    for key in order:
        keep = []
        for one in key[1].split("\n"):
            words = frozenset(one.lower().split())
            if not words or not any(10 * len(words & e) >= 9 * len(words | e) for e in earlier):
                keep.append(one)
            earlier += [words] if words else []
        want[key] = "\n".join(keep)
    assert {x.number: x.text for x in lines.dedup_lines(frame).collect()} == {i: want[t] for i, t in enumerate(texts)}
    gone = repeats.brute_force([((d, mark(t)), t.encode()) for d, t in order])
    left = sorted((d, len(t.encode()), int(gone[d, mark(t)].sum())) for d, t in texts)
    assert sorted((x.doc_id, x.n_bytes, x.n_removed) for x in repeats.remove_repeats(frame).collect()) == left
    sets = {t: shingles(t[1]) for t in order}
    root = {d: d for d, _ in texts}
    for _ in range(4):
        for x in order:
            for y in order:
                if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                    root[x[0]] = root[y[0]] = min(root[x[0]], root[y[0]])
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_duplicates(frame).collect()) == sorted((d, len(shingles(t)), root[d]) for d, t in texts)
    judged = {x.number: (x.n_words, x.n_repeat_words) for x in quality.judge(frame, None).collect()}
    assert judged == {i: tuple(np.array(quality.rule_counts(t))[[0, 4]]) for i, (_, t) in enumerate(texts)} and judged[6][0] == 6000
    found = decontam.find_leaks(frame, spark.createDataFrame([(1, line[3000:3400]), (2, "y" * 50_000), (3, long.split("\n")[3])], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(3, 1), (4, 1), (0, 3), (2, 3), (3, 3)}
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = dac.tokenize(frame, path).orderBy("start").collect()
    in_order = sorted(texts)
    assert [np.frombuffer(x.ids, "<u4").tolist() for x in got] == [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in in_order]
