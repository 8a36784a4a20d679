"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import SPACE, few, materialise, words

WINDOW = 5
#: The share of documents, in percent, that lies in a tail of each measure; the sketch tells where the tail begins.
TAIL = {"symbol_rate": 15, "dup_line_rate": 3, "word_length": 15}
#: A fence lies this many spreads (from the lower tail to the upper one) beyond the tail's beginning.
REACH = 2
#: A group with fewer documents takes the sketch of its language, or else of everything.
LEAST_DOCS = 100


def _first_windows(words_col: str) -> Column:
    """A hash for each window of five words."""
    return F.expr(
        f"CASE WHEN size({words_col}) >= {WINDOW} THEN transform(sequence(0, size({words_col}) - {WINDOW}),"
        f" i -> xxhash64({', '.join(f'{words_col}[i + {k}]' for k in range(WINDOW))})) ELSE array() END"
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """The counts that the rules look at, one row per input row.

    A null text has no words and all counts are 0. Repeated rows are judged
    each on its own. Only `keep` of the other columns survive, so that names
    cannot clash. Windows are compared by 64-bit hashes inside one text. All
    work is on single rows; nothing is shuffled.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        *[F.col(c) for c in keep or []],
    )
    rows = rows.withColumn("_words", words(F.col("_text")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("_windows", _first_windows("_words"))
    rows = rows.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_windows)) < size(_windows)"
            " THEN sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i)))"
            " ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"
        ),
    )
    rows = rows.withColumn(
        "_again",
        F.expr(
            "sort_array(transform(filter(_sorted, (x, j) -> (j > 0 AND try_element_at(_sorted, j).h = x.h)"
            " OR (j + 1 < size(_sorted) AND try_element_at(_sorted, j + 2).h = x.h)), x -> x.i))"
        ).alias("_again"),
    )
    covered = F.expr(
        "aggregate(transform(_again, (x, j) -> CASE WHEN j + 1 < size(_again)"
        f" THEN least({WINDOW}, try_element_at(_again, j + 2) - x) ELSE {WINDOW} END),"
        " 0, (total, x) -> total + x)"
    )
    return rows.select(
        "doc_id", *(keep or []),
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("bigint").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]+", "")))
        .cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rates() -> dict[str, Column]:
    """The measures that get adaptive fences, as whole numbers of at least 0."""
    return {
        "symbol_rate": F.expr("CASE WHEN word_chars > 0 THEN n_symbols * 1000 div word_chars ELSE 0L END"),
        "dup_line_rate": F.expr("CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 div n_lines ELSE 0L END"),
        "word_length": F.expr("CASE WHEN n_words > 0 THEN word_chars * 100 div n_words ELSE 0L END"),
    }


def sketch_bucket(value: str) -> str:
    """SQL: the bucket of a whole number: exact below 64, then 32 to each power of two (3 % wide)."""
    e = f"(length(bin({value})) - 6)"
    return f"CASE WHEN {value} < 64 THEN CAST({value} AS BIGINT) ELSE CAST(32 * {e} + ({value} >> {e}) AS BIGINT) END"


def bucket_edges(bucket: str) -> tuple[str, str]:
    """SQL: the smallest and the largest number of a bucket."""
    e = f"CAST({bucket} // 32 - 1 AS INT)"
    low = f"CASE WHEN {bucket} < 64 THEN {bucket} ELSE ({bucket} - 32 * ({bucket} // 32 - 1)) << {e} END"
    high = f"CASE WHEN {bucket} < 64 THEN {bucket} ELSE (({bucket} - 32 * ({bucket} // 32 - 1) + 1) << {e}) - 1 END"
    return low, high


def _spark_sql(text: str) -> str:
    """Whole-number division as Spark writes it."""
    return text.replace("//", "div")


def quantile_sketches(stats: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, docs): counts that merge by adding.

    The sketch of a language is the sum of its sources' and the overall one
    the sum of the languages'; a bucket is at most 3 % wide, so a quantile is
    exact in rank and off by 3 % in value. Groups are added up before the
    shuffle, so a source with a third of all rows costs no more than others.
    """
    measures = F.explode(
        F.array(*[F.struct(F.lit(name).alias("measure"), c.alias("value")) for name, c in rates().items()])
    )
    fine = (
        stats.select("lang", "source", measures.alias("m"))
        .select("lang", "source", "m.measure", F.expr(_spark_sql(sketch_bucket("m.value"))).alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("docs"))
    )
    levels = F.explode(
        F.array(
            F.struct(F.lit(2).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit("").alias("s")),
            F.struct(F.lit(0).alias("level"), F.lit("").alias("l"), F.lit("").alias("s")),
        )
    )
    return (
        fine.select(levels.alias("g"), "measure", "bucket", "docs")
        .groupBy("g.level", F.col("g.l").alias("lang"), F.col("g.s").alias("source"), "measure", "bucket")
        .agg(F.sum("docs").alias("docs"))
    )


def fences(sketches: DataFrame) -> DataFrame:
    """(level, lang, source, n, and per measure where its upper tail begins and its spread).

    Word length also has the place where its lower tail ends.
    """
    low, high = (_spark_sql(x) for x in bucket_edges("bucket"))
    over = "(PARTITION BY level, lang, source, measure"
    share = F.create_map(*[x for k, v in TAIL.items() for x in (F.lit(k), F.lit(v))])[F.col("measure")]
    ranked = sketches.select("level", "lang", "source", "measure", "bucket", "docs", share.alias("share")).selectExpr(
        "level", "lang", "source", "measure", "bucket", "share",
        f"sum(docs) OVER {over} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto",
        f"sum(docs) OVER {over}) AS n",
    )
    tails = ranked.groupBy("level", "lang", "source", "measure").agg(
        F.max("n").alias("n"),
        F.expr(f"min(CASE WHEN 100 * upto >= share * n THEN {low} END)").alias("lower"),
        F.expr(f"min(CASE WHEN 100 * upto >= (100 - share) * n THEN {high} END)").alias("upper"),
    )
    pick = lambda c, name: F.max(F.when(F.col("measure") == name, F.expr(c)))
    return tails.groupBy("level", "lang", "source").agg(
        F.max("n").alias("n"),
        *[pick("upper", name).alias(f"{name}_upper") for name in TAIL],
        *[pick("upper - lower", name).alias(f"{name}_spread") for name in TAIL],
        pick("lower", "word_length").alias("word_length_lower"),
    )


def limits_by_group(stats: DataFrame) -> DataFrame:
    """(lang, source, limit): the highest measures that are allowed, and the least word length.

    A group of fewer than `LEAST_DOCS` documents takes the tails of its language, a rare language those of
    all documents. The spread is the widest of the group's own, its language's and that of all documents, so
    that a group made of copies, which has none, does not refuse all other texts. One rounding unit is the
    least that a fence lies beyond a tail.
    """
    found = fences(quantile_sketches(stats))
    columns = [c for c in found.columns if c not in ("level", "lang", "source")]
    asked = found.where("level = 2").select(
        "lang", "source",
        F.explode(
            F.array(
                F.struct(F.lit(2).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
                F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit("").alias("s")),
                F.struct(F.lit(0).alias("level"), F.lit("").alias("l"), F.lit("").alias("s")),
            )
        ).alias("g"),
    )
    by_level = found.select("level", F.col("lang").alias("l"), F.col("source").alias("s"), *columns)
    usable = F.when((F.col("level") == 0) | (F.col("n") >= LEAST_DOCS), F.col("level"))
    spreads = [f"{m}_spread" for m in TAIL]
    chosen = asked.select("lang", "source", "g.*").join(by_level, ["level", "l", "s"]).groupBy("lang", "source").agg(
        *[F.max_by(c, usable).alias(c) for c in columns if c != "n"],
        *[F.max(F.when(F.col("level") == 2, F.col(c))).alias(f"_{c}") for c in ("n", *spreads)],
    )
    of_language = Window.partitionBy("lang")
    chosen = chosen.withColumns({
        c: F.greatest(c, F.floor(F.sum(F.col(f"_{c}") * F.col("_n")).over(of_language) / F.sum("_n").over(of_language)))
        for c in spreads
    })
    reach = {m: F.greatest(REACH * F.col(f"{m}_spread"), F.lit(1)) for m in TAIL}
    return chosen.select(
        "lang", "source",
        F.struct(
            *[(F.col(f"{m}_upper") + reach[m]).alias(f"{m}_most") for m in TAIL],
            (F.col("word_length_lower") - reach["word_length"]).alias("word_length_least"),
        ).alias("limit"),
    )


def judge(stats: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`rows` (with the columns of `stats`, which are `rows` if not given) plus base_failed and kept.

    A null language or source counts as an empty one. A document is kept if
    it passes the base rules and no measure lies beyond the fences of its language and source. Empty input
    gives no rows, repeated rows are judged each on its own.
    """
    named = {c: F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source")}
    rows = (stats if rows is None else rows).withColumns(named)
    limits = limits_by_group(stats.withColumns(named))
    r = rates()
    inside = (
        (r["symbol_rate"] <= F.col("limit.symbol_rate_most"))
        & (r["dup_line_rate"] <= F.col("limit.dup_line_rate_most"))
        & (r["word_length"] <= F.col("limit.word_length_most"))
        & (r["word_length"] >= F.col("limit.word_length_least"))
    )
    # One row per language and source: rows stay where they are.
    return (
        rows.withColumn("base_failed", base_failed())
        .join(few(limits), ["lang", "source"])
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("limit")
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (any columns besides doc_id, text, lang, source) that are kept.

    A null text has no words and goes, as do all texts of fewer than ten words; a null language or source
    counts as an empty one and stays null in the result. Texts are read twice,
    once for the sketches and once to be judged, and neither shuffled nor written on the way.
    """
    columns = ["doc_id", "text", "lang", "source"]
    counts = materialise(text_statistics(docs.select(*columns), keep=["lang", "source"]))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = whole.select(*[F.col(f"_row.{c}").alias(c) for c in columns], "_row")
    stats = text_statistics(rows, keep=["lang", "source", "_row"])
    # Generated columns keep the optimizer from working the counts out anew wherever a rule names them.
    once = F.inline(F.array(F.struct(*[c for c in stats.columns if c not in ("lang", "source", "_row")])))
    judged = judge(counts, stats.select("lang", "source", "_row", once))
    return judged.where("kept").select("_row.*")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per input row with its counts and the verdict of base rules and adaptive fences."""
    stats = materialise(text_statistics(docs, keep=["lang", "source"]))
    return judge(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle(table: str = "documents") -> str:
    """The same verdicts in SQL."""
    low, high = bucket_edges("bucket")
    bucket = sketch_bucket("value")
    part = lambda value, name, to: f"max(CASE WHEN measure = '{name}' THEN {value} END) AS {name}_{to}"
    share = f"CASE measure {' '.join(f"WHEN '{k}' THEN {v}" for k, v in TAIL.items())} END"
    tail = lambda c: f"CASE WHEN a.n >= {LEAST_DOCS} THEN a.{c} WHEN b.n >= {LEAST_DOCS} THEN b.{c} ELSE z.{c} END"
    reach = lambda m: (
        f"greatest(1, {REACH} * greatest({tail(m + '_spread')}, CAST(floor(t.{m}_spread) AS BIGINT)))")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             row_number() OVER () AS row_id FROM {table}),
w AS (SELECT row_id, u.pos, u.word FROM (SELECT row_id, unnest(list_transform(
        regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x, i: {{'pos': i, 'word': x}})) AS u FROM d)),
win AS (SELECT row_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' '
        || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five FROM w WINDOW o AS (PARTITION BY row_id ORDER BY pos)),
rep AS (SELECT row_id, pos, lead(pos) OVER (PARTITION BY row_id ORDER BY pos) AS next FROM (
        SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, five) AS n FROM win WHERE five IS NOT NULL) WHERE n > 1),
cover AS (SELECT row_id, sum(least({WINDOW}, coalesce(next - pos, {WINDOW}))) AS n FROM rep GROUP BY row_id),
counts AS (SELECT row_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY row_id),
lines AS (SELECT row_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
        SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row_id),
s AS (SELECT d.row_id, d.doc_id, d.lang, d.source, CAST(coalesce(c.n, 0) AS BIGINT) AS n_words,
        CAST(coalesce(c.chars, 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines
      FROM d LEFT JOIN counts c USING (row_id) LEFT JOIN lines l USING (row_id) LEFT JOIN cover USING (row_id)),
r AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_rate,
        CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate,
        CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length FROM s),
m AS (SELECT lang, source, unnest([{{'measure': 'symbol_rate', 'value': symbol_rate}},
        {{'measure': 'dup_line_rate', 'value': dup_line_rate}},
        {{'measure': 'word_length', 'value': word_length}}], recursive := true) FROM r),
g AS (SELECT 2 AS level, * FROM m UNION ALL SELECT 1, lang, '', measure, value FROM m
      UNION ALL SELECT 0, '', '', measure, value FROM m),
k AS (SELECT level, lang, source, measure, {bucket} AS bucket, count(*) AS docs FROM g GROUP BY ALL),
c AS (SELECT *, sum(docs) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
        sum(docs) OVER (PARTITION BY level, lang, source, measure) AS n FROM k),
q AS (SELECT level, lang, source, measure, max(n) AS n, min(CASE WHEN 100 * upto >= {share} * n THEN {low} END) AS lower,
        min(CASE WHEN 100 * upto >= (100 - {share}) * n THEN {high} END) AS upper FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, max(n) AS n, {', '.join(part('upper', x, 'upper') for x in TAIL)},
        {', '.join(part('upper - lower', x, 'spread') for x in TAIL)}, {part('lower', 'word_length', 'lower')}
      FROM q GROUP BY ALL),
t AS (SELECT lang, {', '.join(f'sum({x}_spread * n) / sum(n) AS {x}_spread' for x in TAIL)} FROM f WHERE level = 2 GROUP BY lang),
h AS (SELECT a.lang, a.source, {', '.join(f"{tail(x + '_upper')} + {reach(x)} AS {x}_most" for x in TAIL)},
        {tail('word_length_lower')} - {reach('word_length')} AS word_length_least
      FROM f a JOIN f b ON b.level = 1 AND a.lang = b.lang JOIN f z ON z.level = 0 JOIN t ON t.lang = a.lang WHERE a.level = 2),
x AS (SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, h.* EXCLUDE (lang, source)
      FROM r JOIN h ON r.lang = h.lang AND r.source = h.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbol_rate <= symbol_rate_most AND dup_line_rate <= dup_line_rate_most
  AND word_length <= word_length_most AND word_length >= word_length_least AS kept FROM x
"""
