"""Passages of benchmark items in documents, found by a prefix-filtered join of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import ascii_lower, few, materialise, words

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Words of a shingle; a shorter window is its own shingle.
SHINGLE = 5
#: Up to so many shingles or windows of the benchmark are sent to every executor (about 20 MB).
BROADCAST_ROWS = 100_000

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _tokens(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window, size): every run of ten words, or the whole of a shorter item; null and empty give none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), _tokens(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    return items.select("item_id", "size", F.explode(F.expr(
        "transform(sequence(0, size(w) - size), i -> array_join(slice(w, i + 1, size), ' '))"
    )).alias("window")).distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window, size, k, at, shingle): all shingles of each different window."""
    each = windows.select("window", "size").distinct().withColumn("w", F.split("window", " "))
    each = each.withColumn("k", F.least(F.col("size"), F.lit(SHINGLE)))
    return each.select("window", "size", "k", F.posexplode(F.expr(
        "transform(sequence(0, size - k), i -> slice(w, i + 1, k))")).alias("at", "s")
    ).select("window", "size", "k", "at", _hash("k", [F.get("s", F.lit(j)) for j in range(SHINGLE)]).alias("shingle"))


def _hash(k: str, parts: list[Column]) -> Column:
    return F.xxhash64(F.col(k).cast("int"), *parts)


def _probes(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for every place and shingle size of each document; one at least, with a null shingle."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), _tokens(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w"))
    rows = rows.select("doc_id", "version", "n_words", "w", F.posexplode_outer("w").alias("pos", "_word"))

    def shingle(k: int) -> Column:
        parts = [F.get("w", F.col("pos") + j) if j < k else F.lit(None).cast("string") for j in range(SHINGLE)]
        return F.when(F.col("pos") + k <= F.col("n_words"), F.xxhash64(F.lit(k), *parts))

    if len(sizes) == 1:
        return rows.withColumn("shingle", shingle(sizes[0]))
    return rows.withColumn("shingle", F.explode(F.array(*[shingle(k) for k in sizes])))


def _small(frame: DataFrame) -> bool:
    return frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places where a window occurs, and which items have which window.

    `docs` has doc_id and text; the first result is (doc_id, version, n_words,
    start, size, window) with at least one row per document, whose window is
    null if nothing was found there. `version` is a hash of the text: repeated
    rows count once, different texts under one id each on its own.

    A window that occurs in a document brings all its shingles along, so it is
    enough to look for its rarest: shingles are ordered by how often they occur
    in all documents, and the first of each window is joined with the shingles
    of the documents. What meets is bounded by place and length and then
    compared word for word. A benchmark of bounded size is sent to the
    documents, which then don't move; a larger one is joined by shuffle, and the
    few documents with candidates are read again for the comparison.
    """
    windows = materialise(item_windows(benchmark))
    parts = materialise(_window_shingles(windows))
    sizes = sorted(r.k for r in parts.select("k").distinct().collect()) or [SHINGLE]
    small = _small(parts)
    send = F.broadcast if small else (lambda x: x)
    probes = _probes(docs, sizes)

    seen = (
        probes.select("shingle").join(send(parts.select("shingle").distinct()), "shingle")
        .groupBy("shingle").agg(F.count("*").alias("uses"))
    )
    prefix = (
        parts.join(seen, "shingle")
        .groupBy("window", "size", "k")
        .agg(F.count("*").alias("found"), F.min(F.struct("uses", "shingle", "at")).alias("first"))
        .where(F.col("found") == F.col("size") - F.col("k") + 1)
        .select("window", "size", F.col("first.shingle").alias("shingle"), F.col("first.at").alias("at"))
    )
    prefix = materialise(prefix).withColumnRenamed("shingle", "first")
    start = F.col("pos") - F.col("at")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.expr("slice(w, pos - at + 1, size)"), " ") == F.col("window")
    if small:
        found = probes.join(
            F.broadcast(prefix), (F.col("shingle") == F.col("first")) & inside & same, "left"
        ).where(F.col("window").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
        found = found.select("doc_id", "version", "n_words", start.alias("start"), "size", "window")
    else:
        candidates = (
            probes.select("doc_id", "version", "n_words", "pos", "shingle")
            .join(prefix, F.col("shingle") == F.col("first")).where(inside)
            .select("doc_id", "version", "pos", "at", "size", "window").distinct()
        )
        texts = docs.select("doc_id", F.xxhash64("text").alias("version"), _tokens(F.col("text")).alias("w"))
        c, t = candidates.alias("c"), texts.alias("t")
        met = t.join(c, F.expr("t.doc_id <=> c.doc_id AND t.version = c.version"), "left").withColumn(
            "hit", F.col("window").isNotNull() & same
        )
        found = met.select(
            "t.doc_id", "t.version", F.size("w").alias("n_words"),
            F.when(F.col("hit"), F.col("pos") - F.col("at")).alias("start"),
            F.when(F.col("hit"), F.col("size")).alias("size"), F.when(F.col("hit"), F.col("window")).alias("window"),
        ).distinct()
    return found, windows.select("item_id", "window")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, the words hit, the items found and whether there are any.

    A null text has no words. A word inside several windows counts once.
    `items_sha256` is over the item ids, sorted as strings and joined by
    commas; without items, over the empty string.
    """
    found, items = benchmark_hits(docs, benchmark)
    found = materialise(found)
    places = found.groupBy("doc_id", "version").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("start", "size")))).alias("spans"),
    )
    n_hit = F.expr(
        "aggregate(spans, named_struct('upto', 0, 'n', 0L), (a, x) -> named_struct("
        "'upto', greatest(a.upto, x.start + x.size),"
        "'n', a.n + greatest(0, x.start + x.size - greatest(a.upto, x.start)))).n"
    )
    named = (
        found.where("window IS NOT NULL").select("doc_id", "version", "window").distinct()
        .join(items, "window").select("doc_id", "version", "item_id").distinct()
        .groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    )
    p, n = places.withColumn("n_hit", n_hit).alias("p"), named.alias("n")
    ids = F.coalesce(F.col("n.ids"), F.array().cast("array<string>"))
    return p.join(n, F.expr("p.doc_id <=> n.doc_id AND p.version = n.version"), "left").select(
        "p.doc_id", "p.n_words", "p.n_hit", F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("p.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, all columns kept."""
    found, _ = benchmark_hits(docs.select("doc_id", "text"), benchmark)
    bad = few(found.where("window IS NOT NULL").select("doc_id", "version").distinct()).alias("b")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("v"))
    return rows.join(bad, F.expr("row.doc_id <=> b.doc_id AND v = b.version"), "left_anti").select("row.*")


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same rows in SQL."""
    tokens = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {tokens} AS w FROM {benchmark}),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size,
          unnest(list_transform(range(0, len(w) - least(len(w), {WINDOW}) + 1),
                 lambda k: array_to_string(w[k + 1:k + least(len(w), {WINDOW})], ' '))) AS win FROM i WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM {documents}),
t AS (SELECT doc_id, text, {tokens} AS w FROM d),
p AS (SELECT doc_id, text, size, k, array_to_string(w[k + 1:k + size], ' ') AS win FROM (
        SELECT doc_id, text, w, size, unnest(range(0, len(w) - size + 1)) AS k
        FROM t, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT DISTINCT p.doc_id, p.text, p.k, p.size, win.item_id FROM p JOIN win ON p.win = win.win AND p.size = win.size),
cov AS (SELECT doc_id, text, count(DISTINCT place) AS n FROM (
        SELECT doc_id, text, unnest(range(k, k + size)) AS place FROM hit) GROUP BY ALL),
ids AS (SELECT doc_id, text, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, text, item_id FROM hit) GROUP BY ALL)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256,
  coalesce(cov.n, 0) > 0 AS contaminated
FROM t LEFT JOIN cov ON t.doc_id IS NOT DISTINCT FROM cov.doc_id AND t.text = cov.text
LEFT JOIN ids ON t.doc_id IS NOT DISTINCT FROM ids.doc_id AND t.text = ids.text
"""
