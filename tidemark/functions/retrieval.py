"""Document retrieval: chunks, terms, BM25, vectors, fusion, versions, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import ship_package, written

#: What a term is, and words that are none.
TERM = "[a-z0-9]+(?:[._-][a-z0-9]+)*"
STOPWORDS = (
    "a an and are as at be by do does for from has have how i if in is it its of on or "
    "should that the this to was what when where which who why will with"
).split()
K1, B, FUSION = 1.5, 0.75, 60


def terms(text: Column) -> Column:
    """Lower-case terms in order, without stopwords; codes keep their inner marks."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def fixed_windows(documents: DataFrame, key: str, text: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """chunk (from 0) and words of windows of `size` words that share `overlap` words with the next."""
    words = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != "")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("_words") - overlap) / step) - 1, F.lit(0)).cast("int"))
    rows = documents.withColumn("_words", words).select(key, "_words", F.explode(starts).alias("chunk"))
    return rows.select(key, "chunk", F.array_join(F.slice("_words", F.col("chunk") * step + 1, size), " ").alias("chunk_text"))


def term_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length: the inverted index."""
    rows = documents.select(key, terms(F.col(text)).alias("_terms")).withColumn("length", F.size("_terms"))
    return rows.select(key, "length", F.explode("_terms").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


#: Queries whose scores are held together, and documents of a batch.
QUERIES, DOCUMENTS = 256, 512


class Best:
    """The k best (score, key) of each of some queries, of all that are added; equal scores (to 9 places) by smaller key."""

    def __init__(self, k: int, n: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of documents (rows) for the queries (columns); -inf for those that are not to be found."""
        rounded = np.round(scores, 9)
        row, query = np.nonzero((rounded >= self.least) & np.isfinite(scores))
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, scores[row, query]])
        self.key = keys[row] if self.key is None else np.concatenate([self.key, keys[row]])
        if len(self.query) > 4 * self.k * len(self.least) + 100_000:
            self.cut()

    def cut(self) -> None:
        """Leaves the best alone."""
        if self.key is None:
            return
        order = np.lexsort((np.unique(self.key, return_inverse=True)[1], -np.round(self.score, 9), self.query))
        query = self.query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.query, self.score, self.key = self.query[order], self.score[order], self.key[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.least)) == self.k)
        worst = np.full(len(self.least), np.inf)
        np.minimum.at(worst, self.query, np.round(self.score, 9))
        self.least[full] = worst[full]


def _blocks(queries: DataFrame, *columns: str):
    """The queries, which are a stated set, QUERIES at a time."""
    block = []
    for row in queries.select(*columns).orderBy(columns[0]).toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            yield block
            block = []
    if block:
        yield block


def _best(rows: DataFrame, blocks, scorer, query: T.StructField, key: T.StructField, score: str, k: int) -> DataFrame:
    """query, key, score and place of the k best for each query. scorer(block) makes (batches -> scores, keys).

    A task keeps k rows of a query; only those are shuffled.
    """
    ship_package(rows.sparkSession)
    kinds = T.StructType([T.StructField(query.name, query.dataType), T.StructField(key.name, key.dataType), T.StructField(score, T.DoubleType())])
    types, out = to_arrow_schema(kinds), None
    for block in blocks:
        names, scored = [r[0] for r in block], scorer(block)

        def run(batches, names=names, scored=scored):
            best = Best(k, len(names))
            for scores, keys in scored(batches):
                best.add(scores, keys)
            best.cut()
            if len(best.query):
                columns = [pa.array([names[q] for q in best.query], types.field(0).type), pa.array(best.key, types.field(1).type), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(columns, types.names)

        part = rows.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], kinds)
    place = F.row_number().over(Window.partitionBy(query.name).orderBy(F.round(score, 9).desc(), key.name))
    return out.withColumn("place", place).where(F.col("place") <= k)


def bm25(documents: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """query, doc, score, place of the k best documents for each query, of those that share a term with it.

    The texts are read once, into counts of the queries' terms; document frequencies and the average length come from all
    documents. Scores are products of a batch's weights with a block of queries, so pairs are never rows.
    """
    blocks = [list(x) for x in _blocks(queries.select(query, F.array_distinct(terms(F.col(text))).alias("terms")), query, "terms")]
    spark = documents.sparkSession
    ship_package(spark)
    known = sorted({t for block in blocks for r in block for t in r.terms or ()})
    words = spark.sparkContext.broadcast(known)

    def count(batches):
        table = pa.array(words.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            at = pc.index_in(lists.flatten(), table)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            pair, n = np.unique(row[hit] * max(1, len(table)) + at.drop_null().to_numpy(), return_counts=True)
            of, term = np.divmod(pair, max(1, len(table)))
            cuts = np.searchsorted(of, np.arange(len(lengths) + 1)).astype(np.int32)
            pack = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pack(term), pack(n)], [doc, "length", "term", "tf"])

    field = documents.schema[doc]
    kinds = T.StructType([field, T.StructField("length", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    index = written(documents.select(doc, terms(F.col(text)).alias("terms")), count, kinds, "term-counts")
    total = index.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    frequency = np.zeros(len(known))
    for r in index.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
        frequency[r.term] = r["count"]
    idf = np.log(1 + (total.n - frequency + 0.5) / (frequency + 0.5))
    mean = max(total.mean or 0.0, 1e-9)

    def scorer(block):
        place = {t: i for i, t in enumerate(sorted({t for r in block for t in r.terms or ()}))}
        asked = np.zeros((len(place), len(block)))
        for j, r in enumerate(block):
            asked[[place[t] for t in r.terms or ()], j] = 1
        own = np.full(len(known) + 1, -1)
        own[np.searchsorted(known, sorted(place))] = np.arange(len(place))
        shared = spark.sparkContext.broadcast((asked, own, idf))

        def scores(batches):
            asked, own, idf = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, DOCUMENTS):
                    batch = whole.slice(at, DOCUMENTS)
                    lists, tf = batch.column(2), batch.column(3).flatten().to_numpy()
                    term = lists.flatten().to_numpy()
                    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
                    length = batch.column(1).to_numpy()[row]
                    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                    some = own[term] >= 0
                    matrix = np.zeros((batch.num_rows, len(asked)))
                    matrix[row[some], own[term[some]]] = weight[some]
                    found = matrix @ asked
                    yield np.where(found > 0, found, -np.inf), batch.column(0).to_numpy(zero_copy_only=False)

        return scores

    return _best(index, blocks, scorer, queries.schema[query], field, "score", k)


def hashed_vectors(documents: DataFrame, key: str, text: str, size: int = 512) -> DataFrame:
    """key, bucket, value: unit vectors of hashed term counts, sparse."""
    rows = documents.select(key, F.explode(terms(F.col(text))).alias("term"))
    digits = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long")
    counts = rows.groupBy(key, (digits % size).cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("value"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    return counts.join(norm, key).select(key, "bucket", (F.col("value") / F.col("norm")).alias("value"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays, as a double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: str) -> Column:
    """The vector at length 1."""
    return F.transform(vector, lambda x: x.cast("double") / F.sqrt(dot(vector, vector)))


def vector_search(vectors: DataFrame, queries: DataFrame, key: str, query: str, column: str, k: int) -> DataFrame:
    """query, key, similarity, place: the exact k nearest by cosine, of a stated set of queries against all rows.

    A block of QUERIES queries is a matrix, which is what is broadcast; each batch of vectors is multiplied with it.
    """

    def units(rows) -> np.ndarray:
        out = np.array(rows, np.float64)
        return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-300)

    def scorer(block):
        shared = vectors.sparkSession.sparkContext.broadcast(units([r[1] for r in block]).T)

        def scores(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 4 * DOCUMENTS):
                    batch = whole.slice(at, 4 * DOCUMENTS)
                    lists = batch.column(1)
                    yield units(lists.flatten().to_numpy().reshape(len(lists), -1)) @ shared.value, batch.column(0).to_numpy(zero_copy_only=False)

        return scores

    rows = vectors.select(key, column).where(F.col(column).isNotNull())
    return _best(rows, _blocks(queries.where(F.col(column).isNotNull()), query, column), scorer, queries.schema[query], vectors.schema[key], "similarity", k)


def fuse(rankings: Sequence[DataFrame], query: str, key: str, depth: int = 50, constant: int = FUSION) -> DataFrame:
    """query, key, score: the sum of 1 / (constant + place) over the first `depth` of rankings of (query, key, score), scores over 0 only."""
    out = None
    for ranking in rankings:
        place = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key))
        part = ranking.where("score > 0").withColumn("place", place).where(F.col("place") <= depth).select(query, key, (1 / (constant + F.col("place"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(query, key).agg(F.sum("part").alias("score"))


MODES = ("hybrid", "text", "vector")


def hybrid_search(chunks: DataFrame, queries: DataFrame, key: str, query: str, text: str, vector: str, k: int = 5, mode: str = "hybrid", as_of: str | None = None, versions: Sequence[str] | None = None) -> DataFrame:
    """query, key, score, place: the k best chunks in force, by words, by vectors, or by both, fused.

    `versions` names the columns document, version, effective date and status; with them, only current chunks are searched,
    or those in force on a date. k is from 1 to 10.
    """
    if mode not in MODES or not 1 <= k <= 10:
        raise ValueError(f"mode is one of {', '.join(MODES)}, and k from 1 to 10")
    if versions is not None:
        chunks = in_force(chunks, *versions, as_of)
    elif as_of is not None:
        raise ValueError("a date needs versions")
    depth, found = 4 * k + 10, []
    if mode != "vector":
        found.append(bm25(chunks, queries, key, query, text, depth))
    if mode != "text":
        found.append(vector_search(chunks, queries, key, query, vector, depth).withColumnRenamed("similarity", "score"))
    ranked = fuse(found, query, key, depth) if len(found) > 1 else found[0].select(query, key, "score")
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key))
    return ranked.withColumn("place", place).where(F.col("place") <= k)


def in_force(chunks: DataFrame, doc: str, version: str, effective: str, status: str, as_of: str | None = None) -> DataFrame:
    """Chunks of the current versions, or of each document's latest version effective by a date."""
    if as_of is None:
        return chunks.where(F.col(status) == "current")
    known = chunks.where(F.col(effective) <= F.lit(as_of).cast("date"))
    latest = known.groupBy(doc).agg(F.max_by(version, F.struct(effective, version)).alias(version))
    return known.join(latest, [doc, version], "left_semi")


def retrieval_quality(ranked: DataFrame, wanted: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """One row: hit@1, hit@k and mean reciprocal rank of rankings with their places; a question whose document is not in them counts 0."""
    found = wanted.join(ranked.select(query, key, "place"), [query, key], "left")
    hit = lambda n: F.avg(F.coalesce(F.col("place") <= n, F.lit(False)).cast("double"))
    return found.agg(hit(1).alias("hit_1"), hit(k).alias("hit_k"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"))


#: Words by which a passage is looked for before texts are compared: its second to fifth, which white space ends.
ANCHOR = 4


def containing(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str) -> DataFrame:
    """doc, item: the documents whose text has the item's text in it.

    Documents and items meet on runs of ANCHOR words; items of fewer than ANCHOR + 2 words, which have none that white
    space encloses, are compared with all documents.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - ANCHOR + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("_words", i, ANCHOR), " ")))
    asked = items.select(item, F.col(text).alias("_item"), words.alias("_words")).where("_item IS NOT NULL")
    long = F.size("_words") >= ANCHOR + 2
    anchors = asked.where(long).select(item, "_item", F.xxhash64(F.array_join(F.slice("_words", 2, ANCHOR), " ")).alias("_anchor"))
    bodies = documents.select(doc, F.col(text).alias("_body"), words.alias("_words"))
    places = bodies.select(doc, F.explode(F.array_distinct(runs)).alias("_anchor")).join(anchors.select("_anchor", item), "_anchor").select(doc, item).distinct()
    found = places.join(bodies.select(doc, "_body"), doc).join(asked.select(item, "_item"), item)
    few = bodies.select(doc, "_body").crossJoin(asked.where(~long).select(item, "_item"))
    return found.unionByName(few.select(*found.columns)).where(F.contains("_body", "_item")).select(doc, item).distinct()


def answerable(ranked: DataFrame, query: str, least: float) -> DataFrame:
    """query, answerable: whether its best similarity reaches the floor."""
    return ranked.groupBy(query).agg((F.max("similarity") >= least).alias("answerable"))


def front_matter(pages: DataFrame, text: str, fields: Sequence[str]) -> DataFrame:
    """A column for each field of the block between the first two lines of dashes (null if it lacks it), and `body`."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    each = {f: F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{f}:\s*(.*)$", 1)), F.lit("")) for f in fields}
    return pages.withColumns(each).withColumn("body", F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", ""))


#: What the front matter of a document must have, and how notices begin that are no part of it before its first section.
FIELDS = ("doc_id", "title", "version", "status", "effective_date")
NOTICES = ("> **Fictional", "> **Synthetic", "> **All data")
CHUNK = "chunk int, section string, chunk_text string, chunk_id string"


def lacking(pages: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The pages that lack a field of their front matter, with the names of what they lack."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return pages.withColumn("lacking", missing).where(F.size("lacking") > 0)


def slug(text: str) -> str:
    """A heading as part of an id: at most 48 lower-case letters and digits with hyphens between."""
    words = "".join(c if c.isascii() and (c.islower() or c.isdigit()) else " " for c in text.lower()).split()
    return "-".join(words)[:48].strip("-") or "intro"


def heading_chunks(pages: DataFrame, key: str, text: str, version: str | None = None, most: int = 220, least: int = 40) -> DataFrame:
    """key, chunk, section, chunk_text, chunk_id: Markdown in chunks of whole blocks under their path of headings.

    Blocks are parted by empty lines; code and tables stay whole. A heading closes the chunk before it, and a chunk
    closes when the next block would take it over `most` words and it has `least`. The title (one #) is no section, and
    notices before the first section are left out. Ids are key@version#heading-number.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType=CHUNK)
    class Chunks:
        def eval(self, name: str, body: str):
            for i, (section, part) in enumerate(chunk_blocks(body or "", most, least)):
                yield i, section, part, f"{name}#{slug(section.split(' > ')[-1])}-{i}"

    ship_package(pages.sparkSession)
    function = f"tidemark_chunks_{most}_{least}"
    pages.sparkSession.udtf.register(function, Chunks)
    name = F.col(key).cast("string") if version is None else F.concat_ws("@", F.col(key).cast("string"), F.col(version).cast("string"))
    source = pages.select(F.col(key), F.col(text).alias("_text"), name.alias("_name"))
    return pages.sparkSession.sql(f"SELECT d.`{key}`, c.* FROM {{d}} d, LATERAL {function}(d._name, d._text) c", d=source)


def repeated_ids(chunks: DataFrame, column: str = "chunk_id") -> DataFrame:
    """Ids that several chunks have, with their number: none, if all is well."""
    return chunks.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def cited(chunks: DataFrame, title: str, version: str, section: str = "section") -> Column:
    """The citation of a chunk: title, version and section."""
    where = F.when(F.col(section) != "", F.concat(F.lit(", "), F.col(section))).otherwise("")
    return F.concat(F.col(title), F.lit(" (version "), F.col(version).cast("string"), F.lit(")"), where)


def body_parts(body: str):
    """(heading level or 0, text) of each heading and block of a Markdown text."""
    held: list[str] = []
    fenced = table = False
    for line in [*body.split("\n"), ""]:
        level = len(line) - len(line.lstrip("#")) if line.startswith("#") else 0
        heading = not fenced and 1 <= level <= 6 and line[level : level + 1] == " "
        fence = line.startswith("```")
        row = line.startswith("|")
        if held and not fenced and not fence and (heading or not line.strip() or row != table):
            yield 0, "\n".join(held).strip()
            held = []
        if heading:
            yield level, line[level:].strip()
        elif fenced or fence or line.strip():
            held.append(line)
        table = row
        if fence:
            fenced = not fenced
            if not fenced:
                yield 0, "\n".join(held).strip()
                held = []
    if held:
        yield 0, "\n".join(held).strip()


def chunk_blocks(body: str, most: int, least: int) -> list[tuple[str, str]]:
    """(section, text) of each chunk; the section is the path of headings below the title."""
    out: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []
    size, begun = 0, False

    def close():
        nonlocal held, size
        if held:
            out.append((" > ".join(t for _, t in path), "\n\n".join(held)))
        held, size = [], 0

    for level, text in body_parts(body):
        if level:
            close()
            if level > 1:
                begun = True
                path = [*(h for h in path if h[0] < level), (level, text)]
        elif begun or not text.startswith(NOTICES):
            words = len(text.split())
            if held and size >= least and size + words > most:
                close()
            held.append(text)
            size += words
    close()
    return out
