"""Operators 1 and 3: held-out accuracy and the parts of the methods; the pipeline stage by stage."""

from __future__ import annotations

import random
import sys
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

pytest.importorskip("shiprisk.llm")

import llm_data as data  # noqa: E402

from shiprisk.llm import langid, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def fold(doc_id, buckets):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % buckets


def test_language_held_out_accuracy(spark, tmp_root):
    held = [r for r in data.rows(300, seed=31)] + data.awkward()
    folder = data.save(spark, tmp_root, documents=data.documents(spark, held))
    got = langid.query(spark, folder).collect()
    assert len(got) == len(held)
    lang = {r[0]: r[2] for r in held if r[0] is not None and r[0] < 1000}
    out = [r for r in got if r.doc_id in lang and r.held_out]
    assert out and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}


def test_language_on_the_given_table(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = [r for r in langid.query(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) >= 0.98


def test_codes_keep_letters_only():
    for text in ["Ab1 c--d", "", None, "123 !", "é日本́x", "A" * 10]:
        plain, letter = "", False
        for c in (text or "").lower():
            if unicodedata.category(c)[0] == "L":
                plain, letter = plain + c, True
            elif not plain.endswith(" "):
                plain += " "
        want = f" {plain.strip()} " if letter else ""
        assert "".join(map(chr, langid.codes_of(text))) == want


def test_filters_hold_their_members_and_correct_false_positives(monkeypatch):
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 2**63, 4000).astype(np.uint64) for _ in range(70)]  # two planes
    filters = langid.Filters.build([f"l{i:02}" for i in range(70)], members)
    assert len(filters.planes) == 2
    for k in (0, 63, 64, 69):
        at = list(langid.positions(members[k], len(filters.planes[0])))
        plane = filters.planes[k // 64]
        assert all(((plane[a] >> np.uint64(k % 64)) & np.uint64(1)).all() for a in at)
    strange = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    at = list(langid.positions(strange, len(filters.planes[0])))
    share = (((filters.planes[0][at[0]] & filters.planes[0][at[1]]) & np.uint64(1)) > 0).mean()
    assert share == pytest.approx(filters.false_positive[0], rel=0.3)
    text = "some words of no language at all, several of them"
    whole = filters.shares(langid.codes_of(text * 50))
    monkeypatch.setattr(langid, "PIECE", 100)  # pieces count every n-gram once
    assert np.allclose(whole, filters.shares(langid.codes_of(text * 50)))


def test_letters_outside_every_filter_get_a_learned_language(spark, tmp_root):
    """``und`` is only for null and letterless texts; ties of rows go by code point."""
    docs = [(i, text, lang, *rest) for i, text, lang, *rest in data.rows(80) if lang in ("en", "de")]
    strange = ["我们今天去公园散步", "Привет как дела", "x", "Ж", "123 !", None, " "]
    docs += [(5000 + i, t, None, "s", 0) for i, t in enumerate(strange)]
    folder = data.save(spark, tmp_root, documents=data.documents(spark, docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.query(spark, folder).collect()}
    learned = Counter(lang for i, _, lang, *_ in docs if lang and fold(i, 4) != 2)
    usual = min(learned, key=lambda lang: (-learned[lang], lang))
    assert got[5000] == got[5001] == got[5003] == (usual, 0.0)
    assert got[5002][0] in ("en", "de")
    assert [got[5000 + i] for i in (4, 5, 6)] == [("und", 0.0)] * 3


def toxic_rows(n=700):
    rng = random.Random(17)
    stems = {"en": ["idiot", "scum", "loser"], "de": ["lowei"], "fr": ["vequ"]}
    docs, labels = [], []
    for i, text, lang, source, size in data.rows(n, seed=18):
        toxic = rng.random() < 0.3
        if toxic:
            words = text.split()
            for _ in range(4):
                stem = rng.choice(stems[lang])
                words.insert(rng.randrange(len(words)), stem + ("" if lang == "en" else rng.choice(["ta", "ck", "no", "u"])))
            text = " ".join(words)
        docs.append((i, text, lang, source, size))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, tmp_root):
    docs, labels = toxic_rows()
    docs += data.awkward()
    label_df = spark.createDataFrame([*labels, (1000, 1), (1003, None), (5, None), (1005, 0)], "doc_id long, toxic int")
    folder = data.save(spark, tmp_root, documents=data.documents(spark, docs), labels=label_df)
    got = toxicity.query(spark, folder).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert sum(p and t for p, t in out) >= 0.9 * sum(t for _, t in out)
    assert sum(p and not t for p, t in out) <= 0.05 * sum(not t for _, t in out)
    same = {r.score for r in got if r.doc_id in (1005, 1006)}
    assert len(same) == 1


def test_toxicity_learns_from_every_labelled_row(spark, tmp_root, monkeypatch):
    """6,000 clean rows and one marker word in the toxic ones, in several shards: every row is counted and trained on."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2_000)
    n = 6_000
    docs = [(i, f"alpha beta w{i} " + ("zork" if i % 20 == 0 else "gamma"), "en", "s", 9) for i in range(n)]
    docs = spark.createDataFrame(docs, data.SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(n)], "doc_id long, toxic int")
    rows = toxicity.learning_rows(docs, labels)
    assert rows.count() == n
    seen = toxicity._counted(rows)
    assert seen[0, 0].max() == n - n // 20 and seen[0, 1].max() == n // 20
    model = toxicity.train(rows)
    got = {(r.toxic, r.score >= 0.5) for r in docs.join(labels, "doc_id").select(
        "toxic", toxicity.score(docs["text"], model).alias("score")).collect()}
    assert got == {(0, False), (1, True)}


def test_mean_of_equal_changes_is_the_change():
    """Tasks that change the same make the model that one of them makes alone."""
    docs, labels = toxic_rows(60)
    words, y = toxicity.Words([toxicity.word_list(d[1]) for d in docs]), np.array([t for _, t in labels])
    every = np.arange(len(y))
    start = toxicity.Trainer(toxicity._presence(words, every, y), int((1 - y).sum()), int(y.sum()))
    own, other = toxicity.deepcopy(start), toxicity.deepcopy(start)
    own.epoch(words, y, every, np.random.default_rng(1))
    for c in own.changes(start, 7):
        other.moved(c["part"].to_numpy(), c["at"].to_numpy(), c[toxicity.VALUES].to_numpy())
    assert np.allclose(own.dense(), other.dense(), atol=1e-5)
    assert np.allclose(own.model.logits(words), other.model.logits(words), atol=1e-4)


def test_threshold_counts_repeated_values():
    z, y = np.array([0.0, 1.0, 1.0, 6.0]), np.array([0, 0, 1, 1])
    assert toxicity.threshold(z, y, np.array([5, 100, 1, 9])) == 3.5


def test_scores_do_not_depend_on_batches_or_pieces(monkeypatch):
    docs, labels = toxic_rows(200)
    y = np.array([t for _, t in labels])
    model = toxicity.fit([d[1] for d in docs], y, np.arange(len(y)) % 4 == 0)
    functions = toxicity._function_table()
    words = [toxicity.word_list(d[1]) for d in docs[:30]] + [[], [b"a"]]
    whole = model.scores(toxicity.Words(words), functions)
    single = np.concatenate([model.scores(toxicity.Words([w]), functions) for w in words])
    assert np.allclose(whole, single, atol=1e-5)
    # Pooling by definition: every window of every width over the whole text.
    one = toxicity.Words([words[0]])
    x = model.vectors(one)[one.docs[0]]
    tops = []
    for w in toxicity.WIDTHS:
        wide = np.concatenate([x, np.zeros((w - 1, x.shape[1]), np.float32)])
        windows = [sum(wide[i + o] @ model.kernels[w][o] for o in range(w)) for i in range(len(x))]
        tops.append(np.maximum(np.max(windows, axis=0) + model.offsets[w], 0))
    assert np.allclose(np.concatenate(tops) @ model.weights + model.bias, model.logits(one)[0], atol=1e-3)


def test_pieces_of_words():
    words = toxicity.Words([[b"a", b"word", b"longer"], [b"word"], []])
    assert [len(d) for d in words.docs] == [3, 1, 0] and len(words) == 3
    assert words.counts.tolist() == [1, 2, 4]
    again = toxicity.Words([[b"longer"]])
    assert (words.piece_buckets[0][words.pieces_of(np.array([2]))[0]] == again.piece_buckets[0]).all()


def test_threshold_splits_classes():
    z, y = np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])
    assert toxicity.threshold(z, y) == 3.0


def test_models_without_anything_to_learn(spark, tmp_root):
    some = data.documents(spark, [(1, "some text", None, "s", 9), (2, None, None, "s", None)])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    folder = data.save(spark, tmp_root + "/a", documents=some, labels=labels)
    assert {r.lang_pred for r in langid.query(spark, folder).collect()} == {"und"}
    assert {(r.score, r.predicted) for r in toxicity.query(spark, folder).collect()} == {(0.0, 0)}
    empty = data.save(spark, tmp_root + "/b", documents=spark.createDataFrame([], data.SCHEMA),
                      labels=spark.createDataFrame([], "doc_id long, toxic int"))
    assert langid.query(spark, empty).count() == 0 and toxicity.query(spark, empty).count() == 0
