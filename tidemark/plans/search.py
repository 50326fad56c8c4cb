"""Queries on documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import retrieval
from tidemark.functions.ranking import top_k_per_key
from tidemark.plans.catalogue import register
from tidemark.sources.tables import table

STOP = "[" + ", ".join(f"'{w}'" for w in retrieval.STOPWORDS) + "]"
ITEMS = f"""items AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '{retrieval.TERM}'), lambda t: NOT list_contains({STOP}, t)) AS terms FROM benchmark)"""


@register("term_lists", f"WITH {ITEMS} SELECT item_id, CAST(len(terms) AS BIGINT) AS n, array_to_string(terms, ' ') AS joined FROM items")
def term_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", retrieval.terms(F.col("text")).alias("terms"))
    return rows.select("item_id", F.size("terms").cast("long").alias("n"), F.array_join("terms", " ").alias("joined"))


def bm25_ctes(k: int, source: str = "documents", name: str = "", b: float = 0.75, k1: float = 1.5) -> str:
    """CTEs down to scored{name}: the k best documents of the source for each item."""
    return f"""
    docs{name} AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{retrieval.TERM}'), lambda t: NOT list_contains({STOP}, t)) AS terms FROM {source}),
    total{name} AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM docs{name}),
    flat{name} AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM docs{name}), tf{name} AS (SELECT doc_id, length, term, count(*) AS tf FROM flat{name} GROUP BY 1, 2, 3),
    df{name} AS (SELECT term, count(*) AS df FROM tf{name} GROUP BY 1), asked{name} AS (SELECT item_id, unnest(list_distinct(terms)) AS term FROM items),
    every{name} AS (
        SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / mean_length))) AS score
        FROM asked{name} JOIN tf{name} USING (term) JOIN df{name} USING (term), total{name} GROUP BY 1, 2
    ), ranked{name} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM every{name}),
    scored{name} AS (SELECT * FROM ranked{name} WHERE place <= {k})"""


@register("bm25_scores", f"WITH {ITEMS}, {bm25_ctes(10)} SELECT item_id, doc_id, round(score, 5) AS score, CAST(place AS INT) AS place FROM scored")
def bm25_scores(spark, sf_dir):
    rows = retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 10)
    return rows.select("item_id", "doc_id", F.round("score", 5).alias("score"), "place")


NEAREST = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS similarity FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS place FROM s)"""


def nearest(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_search(vectors, queries, "vec_id", "query_id", "embedding", k)


@register("vector_top_k", f"WITH {NEAREST} SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def vector_top_k(spark, sf_dir):
    return nearest(spark, sf_dir, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "place")


@register("answerable_queries", f"WITH {NEAREST} SELECT query_id, max(similarity) >= 0.6 AS answerable FROM r WHERE place <= 10 AND query_id <> vec_id GROUP BY 1")
def answerable_queries(spark, sf_dir):
    return retrieval.answerable(nearest(spark, sf_dir, 10).where("query_id <> vec_id"), "query_id", 0.6)


@register(
    "rank_fusion",
    f"""
    WITH {ITEMS}, {bm25_ctes(50)}, {bm25_ctes(50, name="2", b=0.0)},
    p AS (SELECT item_id, doc_id, 1.0 / (60 + place) AS part FROM scored WHERE score > 0 UNION ALL SELECT item_id, doc_id, 1.0 / (60 + place) FROM scored2 WHERE score > 0),
    f AS (SELECT item_id, doc_id, sum(part) AS score FROM p GROUP BY 1, 2)
    SELECT item_id, doc_id, round(score, 8) AS score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 5
    """,
)
def rank_fusion(spark, sf_dir):
    """Two rankings by words, one of which does not mind how long a document is."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rankings = [retrieval.bm25(documents, items, "doc_id", "item_id", "text", 50, b=b) for b in (0.75, 0.0)]
    fused = retrieval.fuse(rankings, "item_id", "doc_id", 50)
    return top_k_per_key(fused, "item_id", [F.round("score", 9).desc(), F.col("doc_id")], 5).select("item_id", "doc_id", F.round("score", 8).alias("score"))


IN_FORCE = """chunks AS (
        SELECT d.doc_id, d.text, e.embedding, d.doc_id % 100 AS family, d.doc_id // 100 AS version FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id
    ), force AS (SELECT * FROM chunks WHERE DATE '2024-01-01' + INTERVAL 1 DAY * CAST(version AS INT) <= DATE '2024-01-03' QUALIFY version = max(version) OVER (PARTITION BY family))"""


@register(
    "hybrid_search",
    f"""
    WITH {IN_FORCE}, asking AS (SELECT b.item_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id),
    items AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '{retrieval.TERM}'), lambda t: NOT list_contains({STOP}, t)) AS terms FROM asking), {bm25_ctes(30, "force")},
    v AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM force), q AS (SELECT item_id, embedding::DOUBLE[] AS e FROM asking),
    s AS (SELECT item_id, doc_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS score FROM q, v),
    near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s),
    p AS (
        SELECT item_id, doc_id, 1.0 / (60 + place) AS part FROM scored WHERE score > 0
        UNION ALL SELECT item_id, doc_id, 1.0 / (60 + place) FROM near WHERE place <= 30 AND score > 0
    ), f AS (SELECT item_id, doc_id, sum(part) AS score FROM p GROUP BY 1, 2)
    SELECT item_id, doc_id, round(score, 8) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS place FROM f QUALIFY place <= 5
    """,
)
def hybrid_search(spark, sf_dir):
    """Documents in versions, of which those in force on a day are searched by words and by vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_of"), "embedding")
    chunks = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vector_of")).select(
        "doc_id", "text", "embedding", (F.col("doc_id") % 100).alias("family"), F.floor(F.col("doc_id") / 100).alias("version")
    )
    chunks = chunks.withColumn("effective", F.date_add(F.lit("2024-01-01").cast("date"), F.col("version").cast("int"))).withColumn("status", F.lit("current"))
    items = table(spark, sf_dir, "benchmark")
    items = items.join(vectors, F.col("item_id") == F.col("vector_of")).select("item_id", "text", "embedding")
    found = retrieval.hybrid_search(chunks, items, "doc_id", "item_id", "text", "embedding", 5, "hybrid", "2024-01-03", ("family", "version", "effective", "status"))
    return found.select("item_id", "doc_id", F.round("score", 8).alias("score"), "place")


@register("containing_documents", "SELECT doc_id, item_id FROM documents JOIN benchmark b ON contains(documents.text, b.text)")
def containing_documents(spark, sf_dir):
    return retrieval.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")


@register(
    "retrieval_quality",
    f"""
    WITH {ITEMS}, {bm25_ctes(10)}, w AS (SELECT item_id, min(doc_id) AS doc_id FROM documents JOIN benchmark b ON contains(documents.text, b.text) GROUP BY 1)
    SELECT round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_k, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr FROM w LEFT JOIN scored USING (item_id, doc_id)
    """,
)
def retrieval_quality(spark, sf_dir):
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    wanted = retrieval.containing(documents, items, "doc_id", "item_id", "text").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    row = retrieval.retrieval_quality(retrieval.bm25(documents, items, "doc_id", "item_id", "text", 10), wanted, "item_id", "doc_id", 5)
    return row.select(*[F.round(c, 6).alias(c) for c in ("hit_1", "hit_k", "mrr")])


@register(
    "fixed_windows",
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, e' \t\n\r'), '\s+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, words, unnest(range(0, CAST(greatest(ceil((len(words) - 20) / 100.0), 1) AS BIGINT))) AS chunk FROM w)
    SELECT doc_id, CAST(chunk AS INT) AS chunk, array_to_string(words[chunk * 100 + 1 : chunk * 100 + 120], ' ') AS chunk_text FROM s
    """,
)
def fixed_windows(spark, sf_dir):
    return retrieval.fixed_windows(table(spark, sf_dir, "documents"), "doc_id", "text")


@register(
    "versions_in_force",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1",
)
def versions_in_force(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("effective"), F.lit("current").alias("status"))
    return retrieval.in_force(rows, "o_custkey", "o_orderkey", "effective", "status", "1997-06-30").select("o_orderkey", "o_custkey")


_DIGIT = "(strpos('0123456789abcdef', substr(md5(term), {0}, 1)) - 1)"


@register(
    "hashed_vectors",
    f"""
    WITH d AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{retrieval.TERM}'), lambda t: NOT list_contains({STOP}, t))) AS term FROM documents),
    c AS (SELECT doc_id, CAST(({_DIGIT.format(6)} * 256 + {_DIGIT.format(7)} * 16 + {_DIGIT.format(8)}) % 512 AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1, 2)
    SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c
    """,
)
def hashed_vectors(spark, sf_dir):
    rows = retrieval.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "bucket", F.round("value", 6).alias("value"))


@register("heading_chunks")
def heading_chunks(spark, sf_dir):
    """Whole texts as they are, in chunks of blocks; a test holds them against their own blocks."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return retrieval.heading_chunks(pages, "doc_id", "text", "lang")


@register(
    "front_matter",
    """SELECT doc_id, lang AS title, CAST(doc_id % 7 AS VARCHAR) AS version, coalesce(text, '') AS body, lang || ' (version ' || doc_id % 7 || '), Scope' AS citation FROM documents""",
)
def front_matter(spark, sf_dir):
    """A front matter put before each text is read again, and cited."""
    head = F.concat(F.lit("---\ntitle: "), "lang", F.lit("\nversion:  "), (F.col("doc_id") % 7).cast("string"), F.lit(" \n---\n"), F.coalesce("text", F.lit("")))
    pages = table(spark, sf_dir, "documents").select("doc_id", head.alias("page"))
    read = retrieval.front_matter(pages, "page", ("title", "version")).withColumn("section", F.lit("Scope"))
    return read.select("doc_id", "title", "version", "body", retrieval.cited(read, "title", "version").alias("citation"))
