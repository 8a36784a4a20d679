"""Each stage of the pipeline on its own input, and the entry point."""

import __spark_entry__ as contract
import corpus_pipeline
from tallymark.llm import decontaminate, quality, queries, simhash, suffix
from tallymark.session import materialise

from .helpers import DATA, needs_data


@needs_data
def test_stages_apply_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, DATA))
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        plain = docs.select("doc_id", "text")
        if name == "quality_rules":
            want = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
        elif name == "simhash_near_dedup":
            want = {r.component_id for r in simhash.near_duplicates(plain).collect()}
        elif name == "suffix_array_dedup":
            want = {r.doc_id for r in docs.collect()}
            left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix.repeat_digests(plain).collect()}
            assert all(0 <= left[r.doc_id] - len(r.text.encode()) <= 6 * 50 for r in out.collect())
            assert sum(len(r.text.encode()) == left[r.doc_id] for r in out.collect()) > 0.5 * len(want)
        elif name == "benchmark_decontamination":
            leaks = decontaminate.contamination(plain, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            want = {r.doc_id for r in leaks.where("NOT contaminated").collect()}
        else:
            want = {r.doc_id for r in docs.collect()}
        assert ids == want, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out


@needs_data
def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 50 and rows.columns[-2:] == ["sequence_id", "offset"]


def test_entry_point_has_every_query():
    names = set(contract.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
