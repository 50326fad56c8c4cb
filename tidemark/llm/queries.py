"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import chat, dac, decontam, licenses, lines, minhash, pieces, quality, repeats, warc
from tidemark.llm.catalogue import read, register


@register("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op2_token_files")
def op2_token_files(spark, sf_dir):
    rows = dac.tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op3_licenses", licenses.oracle())
def op3_licenses(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@register("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    rows = pieces.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@register("op5_chat", chat.ORACLE)
def op5_chat(spark, sf_dir):
    return chat.rotate(read(spark, sf_dir, "conversations"))


@register("op6_minhash")
def op6_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@register("op7_quality")
def op7_quality(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    rows = quality.judge(documents, quality.train(documents, read(spark, sf_dir, "labels")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@register("op8_lines")
def op8_lines(spark, sf_dir):
    rows = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@register(
    "op9_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
    ), m AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html)
    SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
           CASE WHEN m.last IS NULL OR m.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN m.last <> p.page_id THEN m.last END AS refers_to
    FROM p LEFT JOIN m ON p.html = m.html AND p.n >= 1000
    """,
)
def op9_warc(spark, sf_dir):
    rows = warc.archive(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op10_repeats")
def op10_repeats(spark, sf_dir):
    rows = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
