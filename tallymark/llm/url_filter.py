"""Allow and block rules for urls, and exact list membership from a cascade of Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import LOWER, UPPER, materialise

#: Bits per listed key and probes per key of a level.
BITS_PER_KEY = 10
PROBES = 6
#: A level of up to so many bits (8 MB) is one value in the plan; beyond, keys are dealt to shards of about 2^20 bits.
ONE_FILTER_BITS = 1 << 26
SHARD_KEYS = 1 << 16

#: The rules of the query, as (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Labels that put a host on the query's block list.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, url.substr(at + 3, F.char_length(url)))
    tail = F.regexp_replace(F.coalesce(tail, F.lit("")), r"(?s)[?#].*$", "")
    host = F.substring_index(tail, "/", 1)
    return F.translate(host, UPPER, LOWER), tail.substr(F.char_length(host) + 1, F.char_length(tail))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as written, e.g. `net/`) and its verdict; null if none fits.

    Host and path count together; of equally long rules the one with the longer
    host wins, then the earlier in the list.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bit(key: Column, level: int, probe: int, bits: int) -> Column:
    """The probe-th bit of a key at a level, by double hashing."""
    one, two = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    mixed = F.shiftrightunsigned(one, 20) + F.shiftrightunsigned(two, 20) * probe
    return F.pmod(mixed, F.lit(bits))


def _filter_words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """(_shard, _words): the bits of all keys of a shard as an array of longs."""
    at = keys.select("_shard", F.explode(F.array_distinct(F.array(*[_bit(F.col("_key"), level, k, bits) for k in range(PROBES)]))).alias("bit"))
    set_words = at.groupBy("_shard", F.expr("bit div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("set")
    )
    empty = keys.select("_shard").distinct().select(
        "_shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bits // 64 - 1).cast("bigint"))).alias("word"),
        F.lit(0).cast("bigint").alias("set"),
    )
    words = set_words.unionByName(empty).groupBy("_shard", "word").agg(F.bit_or("set").alias("set"))
    return words.groupBy("_shard").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("_words")
    )


def _hit(words: Column, key: Column, level: int, bits: int) -> Column:
    bits_of = F.array(*[_bit(key, level, k, bits) for k in range(PROBES)])
    return F.forall(bits_of, lambda b: F.getbit(
        F.element_at(words, (F.shiftright(b, 6) + 1).cast("int")), (b % 64).cast("int")) == 1)


class Cascade:
    """Exact membership of `listed` for every key of `universe`, as a few Bloom filters.

    Level 0 encodes the listed keys of the universe. Level 1 encodes the keys of
    the universe that level 0 takes in wrongly, level 2 the listed keys that
    level 1 takes in wrongly, and so on until a level makes no mistake; each has
    about a fiftieth of the keys of the one two above. A key is judged by the
    first level that does not contain it: an odd level means listed. For keys
    outside the universe the answer may be wrong, as in any Bloom filter.

    Null keys are not listed; repeated keys count once; an empty list gives no
    level, and then nothing is listed.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, key_col: str = "key"):
        keys = universe.select(F.col(key_col).alias("_key")).where("_key IS NOT NULL").distinct()
        wanted = listed.select(F.col(key_col).alias("_key")).where("_key IS NOT NULL").distinct()
        both = keys.join(wanted.withColumn("listed", F.lit(True)), "_key", "left")
        both = materialise(both.select("_key", F.coalesce("listed", F.lit(False)).alias("listed")))
        n = both.where("listed").count()
        self.bits = max(64, 64 * math.ceil(n * BITS_PER_KEY / 64))
        self.shards = 1
        if self.bits > ONE_FILTER_BITS:
            self.shards = 1 << math.ceil(math.log2(n / SHARD_KEYS))
            self.bits = SHARD_KEYS * 2 * BITS_PER_KEY
        self.levels: list[tuple[DataFrame, int]] = []
        sides = [self._sharded(both.where("listed")), self._sharded(both.where("NOT listed"))]
        while n > 0:
            level, bits = len(self.levels), self._bits(n)
            self.levels.append((materialise(_filter_words(sides[0], level, bits)), bits))
            wrong = materialise(self._test(sides[1], level).where("_hit").select("_key", "_shard"))
            n = wrong.count()
            sides = [wrong, sides[0]]

    def _bits(self, n: int) -> int:
        per_shard = math.ceil(n / self.shards)
        return min(self.bits, max(64, 64 * math.ceil(2 * per_shard * BITS_PER_KEY / 64))) if self.shards > 1 else max(
            64, 64 * math.ceil(n * BITS_PER_KEY / 64))

    def _sharded(self, keys: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("_key", F.lit(-1)), F.lit(self.shards)) if self.shards > 1 else F.lit(0).cast("bigint")
        return keys.withColumn("_shard", shard)

    def _test(self, rows: DataFrame, level: int) -> DataFrame:
        """`rows` (with _key and _shard) plus _hit: whether the level contains the key."""
        words, bits = self.levels[level]
        if self.shards == 1:
            met = rows.withColumn("_words", words.select("_words").scalar())
        else:
            met = rows.join(words, "_shard", "left")
        return met.withColumn("_hit", F.coalesce(_hit(F.col("_words"), F.col("_key"), level, bits), F.lit(False))).drop("_words")

    def judge(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """`rows` plus a boolean column: whether the key is listed."""
        out = self._sharded(rows.withColumn("_key", key)).withColumn("_out", F.lit(None).cast("boolean"))
        for level in range(len(self.levels)):
            out = self._test(out, level)
            out = out.withColumn("_out", F.when(F.col("_out").isNull() & ~F.col("_hit"), F.lit(level % 2 == 1)).otherwise(F.col("_out"))).drop("_hit")
        last = F.lit(len(self.levels) % 2 == 1)
        return out.withColumn(name, F.coalesce("_out", last)).drop("_key", "_shard", "_out")


def listed_hosts(hosts: DataFrame, labels: list[str] = LISTED_LABELS) -> DataFrame:
    """(key): the hosts of the universe one of whose labels is on the list of names."""
    return hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels))))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the rule that fits, and allow or block.

    Without a rule, a host on the block list is blocked and any other allowed;
    the list is looked up in a filter cascade over all hosts of `pages`.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = materialise(rows.select(F.col("host").alias("key")).distinct())
    cascade = Cascade(listed_hosts(hosts), hosts)
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    judged = cascade.judge(rows, F.col("host"), "listed")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def oracle(pages: str = "pages") -> str:
    """The same rows in SQL, the list looked up directly."""
    rule = verdict = "NULL"
    for h, p, v in sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule = f"CASE WHEN {fits} THEN '{h + p}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    return f"""
WITH t AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0
      THEN regexp_replace(substr(url, position('://' IN url) + 3), '[?#](.|\\n)*$', '') END, '') AS tail FROM {pages}),
h AS (SELECT page_id, translate(split_part(tail, '/', 1), '{UPPER}', '{LOWER}') AS host,
      substr(tail, length(split_part(tail, '/', 1)) + 1) AS path FROM t)
SELECT page_id, host, path, CAST({rule} AS VARCHAR) AS rule,
  coalesce({verdict}, CASE WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM h
"""
