"""The pipeline against its stages' brute-force versions on a small table."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import ODD  # noqa: E402
from .test_decontaminate import brute as contaminated  # noqa: E402
from .test_jaccard import brute as groups  # noqa: E402
from .test_mixing import size, targets  # noqa: E402
from .test_secret_scan import base_spans  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, documents, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(100 + i, f"document number {i} speaks of subject {i * 7} in its own words {i * 13} and stops at {i}", "en", "ab"[i % 2]) for i in range(30)]
    rows += [(200, rows[0][1], "en", "a"), (201, passage, "en", "a"), (202, "my password=hunter22 is here and the text goes on about it", "en", "b")]
    rows += [(*r, "en", "c") for r in ODD]
    docs = documents(rows)
    folder = tables(spark, tmp_path / "t", docs, [], [(1, passage)])
    step = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, folder).cache()
        kept.append((name, step.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == docs.columns
        if name == "n-gram Jaccard join":
            # every group keeps its least id
            want = {eval(r)[2] for r in groups([(r[0], r[1]) for r in rows], 5, 80, 100) if eval(r)[1]}
            assert {r["doc_id"] for r in step.where("text rlike '\\\\S'").collect()} == want
        if name == "benchmark decontamination":
            bad = {r[0] for r in contaminated([(201, passage)], [(1, passage)]) if r[-1]}
            assert bad == {201} and step.where("doc_id = 201").count() == 0
        if name == "secret scans":
            assert all(not base_spans(r["text"]) for r in step.collect())
            mixed_in = step.collect()
    sizes = {}
    for r in mixed_in:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    for source, want in targets(sizes).items():
        got = sum(r["copies"] * size(r["text"]) for r in step.where(step["source"] == source).collect())
        assert abs(got - want) <= max(size(r["text"]) for r in mixed_in if r["source"] == source)
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, step.collect()))
    assert dict(kept)["quality classifier"] == len(rows)  # nothing to learn from: nothing goes


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_on_the_tables(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert 0 < out.count() < spark.read.parquet(f"{FOLDER}/documents.parquet").count() and "copies" in out.columns


def test_empty_tables(spark, documents, tmp_path):
    folder = tables(spark, tmp_path / "t", documents([]), [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
