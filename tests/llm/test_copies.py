"""Near copies and repeated passages against plain versions."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tallymark.llm import simhash, suffix

from .helpers import DOCS, docs, needs_data, run, whole, words

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = words((text or "").translate(A_TO_Z))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def groups(fps, radius=4):
    """The smallest position that each one is connected with."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def expected(rows):
    rows = sorted(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    return {(rows[i][0], f"{fps[i]:016x}", rows[g][0]) for i, g in enumerate(groups(fps))}


@needs_data
def test_near_duplicates_of_the_test_table(spark):
    got = {tuple(r) for r in run(spark, "op10_simhash_dedup").collect()}
    assert got == expected(whole(spark))


@pytest.mark.parametrize("text", ["", " \n", "A", "a b c", "É a\x1fb c d e f É", "x " * 70_000, "W" * 200_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_near_duplicates_of_odd_rows(spark):
    base = " ".join(f"word{k}" for k in range(300))
    texts = [base, None, "", base + " more", "other text of no words in common", base.upper(), " \t", base]
    frame = docs(spark, *texts).unionByName(docs(spark, base, "only here").withColumn("doc_id", F.lit(None).cast("bigint")))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame.withColumn("fp", F.lit("x"))).collect()}
    want = {(d, c) for d, _, c in expected([(1 + k, t) for k, t in enumerate(texts)])}
    assert got == want | {(None, 1), (None, None)}
    kept = simhash.keep_one(frame.withColumn("_row", F.lit(0)).withColumn("component_id", F.lit(0)))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for _, c in want})
    assert kept.where("doc_id IS NULL").count() == 2 and kept.columns[-2:] == ["_row", "component_id"]
    twice = frame.unionByName(frame)
    assert simhash.keep_one(twice).where("doc_id = 1").count() == 1
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def clusters(seed, n=25):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            x = base
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("rounds", [0, 1, 32])
def test_links_of_one_shard_connect_what_is_near(monkeypatch, seed, rounds):
    monkeypatch.setattr(simhash, "PIVOT_ROUNDS", rounds)
    fps = np.array(clusters(seed), np.uint64)
    a, b = simhash.shard_links(fps, np.zeros(len(fps), np.int64))
    assert all(int(fps[i] ^ fps[j]).bit_count() <= 4 for i, j in zip(a, b, strict=True))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fps))] == groups([int(x) for x in fps])


@pytest.mark.parametrize("shard_rows", [20_000, 10])
def test_links_through_shards_of_any_size(spark, monkeypatch, shard_rows):
    docs(spark)
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    fps = clusters(99, 40)
    reps = spark.createDataFrame([(k, int(np.uint64(x).view(np.int64))) for k, x in enumerate(fps)], "node bigint, fp bigint")
    found = dict(simhash.components(simhash.near_links(reps)).collect())
    assert [found.get(k, k) for k in range(len(fps))] == groups(fps)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 900)] + [(1000, 1000)]
    random.Random(1).shuffle(links)
    found = dict(simhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {k: 0 for k in range(101)} | {k: 500 for k in range(500, 900)}


def plain_repeats(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i:i + 100]
            if w in seen:
                gone[i:i + 100] = True
            seen.add(w)
        runs = int(gone[:1].sum()) + int((np.diff(gone.astype(np.int8)) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def digests(frame, **options):
    return sorted((tuple(r) for r in suffix.repeat_digests(frame, **options).collect()), key=repr)


@needs_data
def test_repeats_of_the_test_table(spark):
    got = sorted(tuple(r) for r in run(spark, "op6_suffix_dedup").collect())
    assert got == plain_repeats(whole(spark))


def tangled(seed, n=40):
    """Texts with shared passages of many lengths, periods and characters of several bytes."""
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcé漢 ") for _ in range(k))
    stock = [make(rng.choice([60, 99, 100, 101, 150, 400])) for _ in range(12)] + ["ab" * 120, "x" * 350]
    return ["".join(rng.choice(stock) if rng.random() < 0.6 else make(rng.randint(0, 90)) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("batches, parts, hot", [(1, 1, 20_000), (2, 3, 20_000), (5, 7, 20_000), (7, 9, 2)])
def test_repeats_by_any_number_of_batches(spark, monkeypatch, batches, parts, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    frame = docs(spark, *tangled(batches)).select("doc_id", "text")
    rows = [tuple(r) for r in frame.orderBy("doc_id").collect()]
    assert digests(frame.repartition(parts), batches=batches) == sorted(plain_repeats(rows), key=repr)


def test_anchors_do_not_depend_on_steps(monkeypatch):
    data = np.frombuffer("".join(tangled(3)).encode(), np.uint8)
    sizes = np.array([len(data) // 3, len(data) - len(data) // 3])
    whole_way = suffix.anchors(data, sizes)
    monkeypatch.setattr(suffix, "STEP", 101)
    assert all(np.array_equal(a, b) for a, b in zip(whole_way, suffix.anchors(data, sizes), strict=True))


def test_buckets_of_anchors_are_even():
    data = np.random.default_rng(7).integers(97, 123, 2_000_000).astype(np.uint8)
    key = np.unique(suffix.anchors(data, np.array([len(data)]))[1])
    for buckets in (1, 32, 512):
        counts = np.bincount(suffix.buckets_of(key, buckets), minlength=buckets)
        assert len(counts) == buckets and counts.max() < 2 * len(key) / buckets


def test_repeats_of_odd_rows(spark):
    long = "".join(random.Random(5).choices("abcdefgh ", k=3000))
    frame = docs(spark, long, None, "", "short", long[:99], long[500:700], "é" * 60, "é" * 200, long).select("doc_id", "text")
    rows = [tuple(r) for r in frame.orderBy("doc_id").collect()]
    assert digests(frame) == sorted(plain_repeats(rows), key=repr)
    nameless = frame.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("bigint"))
    assert digests(frame.unionByName(nameless)) == sorted(plain_repeats([(None, long), *rows]), key=repr)
    assert suffix.repeat_digests(frame.limit(0)).count() == 0
    both = {(r.doc_id, r.n_removed) for r in suffix.repeat_digests(frame.where("doc_id = 1").unionByName(frame.where("doc_id = 1"))).collect()}
    assert both == {(1, 0), (1, 3000)}


def test_repeats_of_nul_bytes(spark):
    make = lambda seed, k: "".join(random.Random(seed).choices("abcdefgh ", k=k))
    padded = make(1, 200) + "\0" * 300 + make(2, 200)
    frame = docs(spark, make(3, 150) + padded, padded + make(4, 99), make(5, 40) + "\0" * 40 + make(6, 40), "\0" * 99,
                 "\0" * 37, make(5, 40) + "\0" * 40 + make(6, 40)).select("doc_id", "text")
    rows = [tuple(r) for r in frame.orderBy("doc_id").collect()]
    assert digests(frame) == sorted(plain_repeats(rows), key=repr)


def test_texts_without_repeats_keep_their_columns(spark):
    passage = "The same passage of more than one hundred bytes, which stands in two texts, is kept in the first one only. "
    frame = docs(spark, "One " + passage, "Two é" + passage + "ü end", None).withColumns({c: F.lit(c) for c in ("block", "sizes", "data", "rows", "ids", "mask")})
    out = suffix.without_repeats(frame)
    assert out.columns == frame.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "One " + passage and rows[2].text == "Two éü end" and rows[2].n_chars == 10
    assert rows[3].text == "" and rows[2].data == "data" and rows[2].lang == "en"


def test_levels_are_arrays_in_byte_order_that_merge_at_equal_size(spark):
    frame = docs(spark, *tangled(11, 80)).select("doc_id", "text")
    table = suffix.blocks(frame, list(range(10, 80, 10)))
    family, sizes = suffix.SuffixFamily(spark), []
    for k in range(8):
        family.add(suffix.batch_suffixes(table.where(F.col("batch") == k), 2))
        sizes.append([size for size, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1], [8]]
    (_, level), = family.levels
    kept = sorted(int(f.name.split("=")[1]) for f in Path(family.folder).glob("level=*"))
    assert [k for k in kept if k > 0] == [level]  # merged levels are gone from the disk
    rows = spark.table(family.name).where(F.col("level") == level).orderBy("bucket", "part").collect()
    seen = set()
    for bucket in {r.bucket for r in rows}:
        parts = [suffix._unpack(r.blob, (np.uint8, r.n * suffix.AROUND), (np.uint8, 2 * r.n))[0] for r in rows if r.bucket == bucket]
        suffixes = [bytes(x) for x in np.concatenate(parts).reshape(-1, suffix.AROUND)]
        assert suffixes == sorted(suffixes) and len(suffixes) > 50
        heads = {x[:suffix.KMER] for x in suffixes}
        assert not heads & seen
        seen |= heads


def test_the_registered_run_merges_levels(spark, monkeypatch):
    sizes, add = [], suffix.SuffixFamily.add

    def noted(self, batch, keep=True):
        add(self, batch, keep)
        sizes.append([size for size, _ in self.levels])

    monkeypatch.setattr(suffix.SuffixFamily, "add", noted)
    frame = docs(spark, *tangled(12)).select("doc_id", "text")
    assert digests(frame) == sorted(plain_repeats([tuple(r) for r in frame.orderBy("doc_id").collect()]), key=repr)
    assert sizes[:3] == [[1], [2], [2, 1]]


def test_each_window_has_one_anchor_and_no_other_bytes_are_kept():
    texts = [t.encode() for t in ["", *tangled(13), "x" * 300, "y" * 99]]
    block = suffix.Block(b"".join(texts), [len(t) for t in texts])
    ends = np.cumsum(block.sizes)
    windows = [s for end, size in zip(ends, block.sizes, strict=True) for s in range(end - size, end - suffix.LENGTH + 1)]
    assert sorted(p - o for p, low, high in zip(block.place, block.low, block.high, strict=True) for o in range(low, high + 1)) == windows
    for p, low, high, row in zip(block.place, block.low, block.high, block.suffixes(), strict=True):
        after = block.data[p:p + suffix.LENGTH - low].tobytes()
        before = block.data[p - high:p].tobytes()[::-1]
        assert row.tobytes() == after.ljust(suffix.LENGTH, b"\0") + before.ljust(suffix.LEFT, b"\0")
