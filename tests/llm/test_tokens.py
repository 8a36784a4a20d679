"""Ids, packing and files against the tokenizers themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallymark.llm import arrow_stream, packing, tokens
from tallymark.llm.common import run_folder, tokenizer

from .helpers import DOCS, crc, docs, needs_data, run, whole

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
SIGNS = [*"ab.,'s \n\t\r\x0b\x1c\x85\xa0 É1²́!", "<|endoftext|>", "'ll", "ñ", "ſ", "K", "Ⅷ", " ", "́", "漢", "🙂"]


def plain(file, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(file)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file, space", FILES)
def test_pieces_give_the_ids_of_the_whole_text(monkeypatch, file, space):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    monkeypatch.setattr(tokens, "REMEMBER", 500)
    whole_way, coder, at = Tokenizer.from_file(tokenizer(file)), tokens.encoder(tokenizer(file), space), 0
    for start in range(0, len(texts), 1000):
        ids, sizes = coder.encode(texts[start:start + 1000])
        at = 0
        for text, n in zip(texts[start:start + 1000], sizes.tolist(), strict=True):
            assert ids[at:at + n].tolist() == whole_way.encode(text, add_special_tokens=False).ids, repr(text)
            at += n


def sequences(rows):
    """Lengths by sequence; each must be without gaps."""
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in out.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return out


def expected_pieces(rows):
    out = []
    for doc_id, text in rows:
        ids, start = [*plain("byte_bpe_50k.json", text), 0], 0
        first = len(ids) % 2048 or 2048
        ends = [len(ids)] if len(ids) <= 2048 else list(range(first, len(ids) + 1, 2048))
        for k, end in enumerate(ends):
            out.append((doc_id, k, start, end - start, crc(ids[start:end])))
            start = end
    return out


@needs_data
def test_packing_of_the_test_table(spark):
    rows = run(spark, "op7_best_fit_pack").collect()
    assert sorted(tuple(r)[:5] for r in rows) == expected_pieces(whole(spark))
    assert len(sequences(rows)) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    frame = docs(spark, None, "", "a", "a a " * 20_000, "b " * 2047, "b " * 2046, *["c"] * 30).withColumn("rank", F.lit(1))
    frame = frame.unionByName(frame.where("doc_id < 4")).unionByName(frame.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = packing.packed_documents(frame, tokenizer("byte_bpe_50k.json")).collect()
    want = expected_pieces([(r.doc_id, r.text) for r in frame.collect()])
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, want))
    sequences(rows)
    assert packing.packed_documents(frame.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0
    with_ids = packing.pieces(frame, tokenizer("byte_bpe_50k.json"), with_ids=True).collect()
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in with_ids)


def fewest(items, capacity):
    """The fewest bins, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1:]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_fewest_bins_within_reach(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 31])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
    counts = {n: items.count(n) for n in set(items)}
    fixed, rest = packing.reduce_instance(counts, capacity)
    left = [n for n, c in rest.items() for _ in range(c)]
    used = [n for pattern, c in fixed for n, k in pattern for _ in range(c * k)]
    assert sorted(used + left) == sorted(items)
    assert sum(c for _, c in fixed) + fewest(left, capacity) == fewest(items, capacity)
    assert all(sum(n * k for n, k in p) <= capacity for p, _ in [*fixed, *packing.best_fit(rest, capacity)])


def test_the_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(3)
    small = {int(n): int(c) for n, c in zip(range(1, 2049), rng.integers(1, 50, 2048), strict=True)}
    large = {n: c * 10_000 for n, c in small.items()}
    rows = [sum(len(v) for v in packing.plan(x).values()) for x in (small, large)]
    assert rows[1] <= 4 * rows[0]


def expected_file_rows(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*plain("word_bpe_49k.json", text), 2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


@needs_data
def test_files_of_the_test_table(spark):
    assert sorted(map(tuple, run(spark, "op9_arrow_stream").collect())) == expected_file_rows(whole(spark))


def test_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(arrow_stream, "FILE_BYTES", 20_000)
    frame = docs(spark, None, "", "a", "word " * 30_000, *["b c"] * 300, first=-2).withColumn("start", F.lit(1))
    frame = frame.unionByName(docs(spark, "no id").withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("start", F.lit(1)))
    frame = frame.unionByName(frame.where("doc_id = 0"))
    rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = arrow_stream.round_trip(frame.repartition(5), tokenizer("word_bpe_49k.json")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected_file_rows(rows)))
    assert arrow_stream.round_trip(frame.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_random_access_to_sequences(spark):
    frame = docs(spark, *[f"word{k} " * 700 for k in range(60)])
    manifest = arrow_stream.write_files(frame, run_folder(spark, "arrow"), tokenizer("word_bpe_49k.json"), length=16)
    ids, ends = [], []
    for row in manifest.orderBy("place").collect():
        file = arrow_stream.SequenceFile(row.file)
        for k in range(-(-row.n_tokens // 16)):
            own, mask, last = file[k]
            assert own.dtype == np.uint16 and len(own) == len(mask) == len(last) == 16 and not own.flags.owndata
            ids += own[mask.to_numpy(zero_copy_only=False)].tolist()
            ends += last.to_numpy(zero_copy_only=False)[mask.to_numpy(zero_copy_only=False)].tolist()
        assert pa.types.is_fixed_size_list(file.reader.schema.field("ids").type)
    want = [[*plain("word_bpe_49k.json", f"word{k} " * 700), 2] for k in range(60)]
    assert ids == [x for w in want for x in w] and sum(ends) == 60 and ends[len(want[0]) - 1]
