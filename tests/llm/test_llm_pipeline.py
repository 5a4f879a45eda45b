"""The pipeline: each stage on its predecessor's rows, against the operator's own result."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

pytest.importorskip("shiprisk.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import llm_data as data  # noqa: E402

from shiprisk.llm import bpe, mixing, quality, secrets, simhash  # noqa: E402
from shiprisk.llm.common import prepare  # noqa: E402


def rows(df, cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_stages_follow_the_operators(spark, tmp_root):
    prepare(spark)
    held = data.rows(90, seed=41) + data.awkward()
    copy = held[0][1]
    held += [(3000 + i, copy, "en", "src0", len(copy)) for i in range(5)]
    held += [(3100, held[1][1] + ' password = "abcdef123456"', "en", "src1", 1)]
    docs = data.documents(spark, held, clashing=False)
    cols = docs.columns
    step = 0
    assert [f for _, f in corpus_pipeline.STAGES] == [
        quality.stage, simhash.stage, secrets.stage, mixing.stage, bpe.stage]
    folder = data.save(spark, f"{tmp_root}/0", documents=docs)
    for _, stage in corpus_pipeline.STAGES:
        before = spark.read.parquet(f"{folder}/documents.parquet")
        n_before = before.count()
        step += 1
        after_folder = data.save(spark, f"{tmp_root}/{step}", documents=stage(spark, before, folder))
        after = spark.read.parquet(f"{after_folder}/documents.parquet")
        if stage is quality.stage:
            kept = {r.doc_id for r in quality.query(spark, folder).collect() if r.kept}
            assert {r.doc_id for r in after.collect()} == kept
            assert {r[0] for r in held[:90]} <= kept
        elif stage is simhash.stage:
            groups = {r.component_id for r in simhash.query(spark, folder).collect()}
            assert after.count() == len(groups)
            ids = {r.doc_id for r in after.collect()}
            assert {g for g in groups if g is not None} <= ids and not ids & {3001, 3002}
        elif stage is secrets.stage:
            assert after.count() == n_before
            assert all("abcdef123456" not in r.text for r in after.collect())
            found = [r for r in secrets.query(spark, after_folder).collect() if r.spans]
            assert not found
        elif stage is mixing.stage:
            want = Counter()
            for r in mixing.query(spark, folder).collect():
                want[r.doc_id] += r.taken // max(r.size, 1)
            assert Counter(r.doc_id for r in after.collect()) == Counter({k: n for k, n in want.items() if n})
        if stage is not bpe.stage:
            assert after.columns == cols
            assert rows(after, cols).keys() <= rows(before, cols).keys() or stage is secrets.stage
        folder = after_folder
    assert rows(after, after.columns) == rows(bpe.query(spark, f"{tmp_root}/4"), after.columns)


def test_run_on_the_given_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_run_on_an_empty_table(spark, tmp_root):
    folder = data.save(spark, tmp_root, documents=spark.createDataFrame([], data.SCHEMA))
    assert corpus_pipeline.run(spark, folder).count() == 0
