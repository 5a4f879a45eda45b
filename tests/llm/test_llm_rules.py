"""Operators 4, 6, 8 and 10 against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

pytest.importorskip("shiprisk.llm")

import llm_data as data  # noqa: E402

from shiprisk.llm import mixing, quality, secrets, urlfilter  # noqa: E402
from shiprisk.llm.common import prepare  # noqa: E402

ASSIGN = re.compile(
    r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SECRETS = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more', "token=token: abcdefgh", "PASSWD : x1",
           "api_key='é' apikey=\"abc.def-1\" éé Secret:=abcdef", "AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 12,
           "deadbeef" * 3 + "g" + "0" * 30, "日本 token: zzzzzz " * 30, "AKIA123 " + "a" * 23,
           "key kJ8fQ2xZ7vLm3PqR9tWb5YcN1dHs6GaE at", "see path/to/some/long/folder/of/files/number/1 there",
           "hex 9f86d081884c7d659a2feaa0c55ad015A3bf4f1b2b0b822cd15d6c15b0f00a08 end",
           "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 111111111111111111111111111111a"]


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark, tmp_root):
    texts = SECRETS + [r[1] for r in data.awkward()]
    held = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    folder = data.save(spark, tmp_root, documents=data.documents(spark, held))
    for r in secrets.query(spark, folder).collect():
        want = base_spans(texts[r.doc_id])
        joined = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        kinds = Counter(k for *_, k in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == joined
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    found = {r.doc_id: r.spans for r in secrets.query(spark, folder).collect()}
    assert "random:4:36" in found[8] and "random" not in found[9] and "random" not in found[11]


def test_randomness_battery_separates_random_strings(spark):
    rng = random.Random(6)
    alphabets = ["0123456789abcdef", secrets.BASE64, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    rand = ["".join(rng.choice(alphabets[i % 3]) for _ in range(rng.randint(32, 64))) for i in range(300)]
    plain = ["".join(rng.choice(["user", "name", "file", "path", "data", "2024", "test"]) for _ in range(10)) + "1"
             for _ in range(300)]
    df = spark.createDataFrame([(w, i < 300) for i, w in enumerate(rand + plain)], "word string, random boolean")
    kept = df.withColumn("p", secrets.p_value(df["word"])).filter("p > 0.01").groupBy("random").count().collect()
    counts = {r["random"]: r["count"] for r in kept}
    assert counts[True] >= 270 and counts.get(False, 0) <= 15


def test_battery_p_value_against_numpy(spark):
    from math import erfc, sqrt

    words = ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "kJ8fQ2xZ7vLm3PqR9tWb5YcN1dHs6GaE", "aaaaabbbbbccccc1111122222"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [r.p for r in df.select(secrets.p_value(df["word"]).alias("p")).collect()]
    tail = lambda z: erfc(z / sqrt(2)) / 2
    for word, p in zip(words, got):
        letters = next((a for pattern, a in secrets.ALPHABETS.items() if re.match(pattern, word)), secrets.BASE64)
        v = np.array([letters.index(c) for c in word], float)
        k, n = len(letters), len(v)
        chi2 = (np.bincount(v.astype(int), minlength=k) ** 2).sum() * k / n - n
        w = 2 / (9 * (k - 1))
        p_chi = tail(((chi2 / (k - 1)) ** (1 / 3) - (1 - w)) / sqrt(w))
        high = v >= k / 2
        ups, runs = high.sum(), 1 + (high[1:] != high[:-1]).sum()
        both = 2 * ups * (n - ups)
        p_runs = 0.0 if both == 0 else 2 * tail(abs(runs - both / n - 1) / sqrt(both * (both - n) / (n * n * (n - 1))))
        c = v - (k - 1) / 2
        p_serial = 2 * tail(abs((c[1:] * c[:-1]).sum()) / (sqrt(n - 1) * (k * k - 1) / 12))
        assert p == pytest.approx(min(1, 3 * min(p_chi, p_runs, p_serial)), abs=1e-5)


def test_secret_stage_masks_and_keeps_rows(spark, tmp_root):
    held = [(i, t, "en", "s", 0) for i, t in enumerate(SECRETS)] + data.awkward()
    df = data.documents(spark, held)
    out = secrets.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == len(held)
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id is not None and r.doc_id < 100}
    for i, text in enumerate(SECRETS):
        merged = []
        for a, _, b, _ in base_spans(text):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want, at = "", 0
        for a, b in merged:
            want, at = want + text[at:a] + "[SECRET]", b
        if i != 8:  # the random string has no base span
            assert by_id[i].text == want + text[at:]
            assert by_id[i].n_chars == (len(by_id[i].text) if merged else 0)
    assert by_id[8].text == "key [SECRET] at"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] >= 2:
            inside |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside))


QUALITY = ["a b c a b c", "x x x x", "a b c\na b c\n\n\n\n \n a b c", "#a $b\x1cc &|<>", "one two three four " * 60,
           " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "p q r s p q r"]


def test_quality_counts_and_base_rules(spark, tmp_root):
    texts = QUALITY + [r[1] for r in data.awkward()]
    held = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + data.rows(50, seed=8)[40:]
    held = [(i, *h[1:]) for i, h in enumerate(held)]
    folder = data.save(spark, tmp_root, documents=data.documents(spark, held))
    got = {r.doc_id: r for r in quality.query(spark, folder).collect()}
    for i, text, *_ in held:
        n, chars, symbols, lines, again = plain_counts(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (r.base_failed and r.kept)


def test_robust_estimate_ignores_outliers_and_matches_a_plain_mcd(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([1.6, 0.1, 0.2, 0.1], np.diag([0.2, 0.1, 0.3, 0.2]) ** 2, 400)
    bad = rng.normal(4, 0.1, (150, 4))
    data_rows = [("g", *map(float, x)) for x in np.vstack([good, bad])] + [("other", *map(float, x)) for x in bad[:50]]
    df = spark.createDataFrame(data_rows, "group string, x0 double, x1 double, x2 double, x3 double").repartition(3)
    est = {r.group: r for r in quality.estimates(df).collect()}
    mean = np.array([est["g"][m] for m in quality.M])
    assert np.abs(mean - good.mean(axis=0)).max() < 0.05
    inverse = np.zeros((4, 4))
    for (i, j), q in zip(quality.PAIRS, quality.Q):
        inverse[i, j] = inverse[j, i] = est["g"][q] / (1 if i == j else 2)
    spread = np.sqrt(np.diag(np.linalg.inv(inverse)))
    want = np.sqrt(good.var(axis=0) + np.square(quality.FLOOR))
    assert (np.abs(spread / want - 1) < 0.25).all()
    # Plain concentration steps from the same kind of start end at the same half.
    x = np.vstack([good, bad])
    m, s = np.median(x, axis=0), (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349
    d = (((x - m) / s) ** 2).sum(axis=1)
    for _ in range(20):
        near = x[np.argsort(d)[:len(x) // 2]]
        cov = np.cov(near.T) * quality.consistency(0.5) + np.diag(np.square(quality.FLOOR))
        d = np.einsum("ij,jk,ik->i", x - near.mean(axis=0), np.linalg.inv(cov), x - near.mean(axis=0))
    near = x[d <= quality.chi2_quantile(quality.REWEIGHT, 4)]
    assert np.abs(mean - near.mean(axis=0)).max() < 0.03


def test_chi2_helpers():
    assert quality.chi2_quantile(0.975, 4) == pytest.approx(11.1433, abs=1e-3)
    assert quality.chi2_quantile(0.5, 4) == pytest.approx(3.3567, abs=1e-3)
    assert quality.chi2_cdf(5.348, 6) == pytest.approx(0.5, abs=1e-3)


def test_quality_stage_rejects_junk_and_keeps_clean(spark, tmp_root):
    clean = data.rows(120, seed=12)
    rng = random.Random(2)
    junk = [(500 + i, " ".join(w + rng.choice(["$$$", "&&&", "***"]) for w in data.words(rng, 90).split()), "en",
             "src0", 1) for i in range(12)]
    df = data.documents(spark, clean + junk + data.awkward())
    kept = quality.stage(spark, df, "")
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) >= {r[0] for r in clean} and not set(ids) & {j[0] for j in junk}
    assert not set(ids) & {1000, 1001, 1002, 1003, 1007} and ids.count(1005) == 2


def plain_targets(sizes):
    """Iterative resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing(spark, tmp_root):
    held = data.rows(200, seed=21) + data.awkward()
    folder = data.save(spark, tmp_root, documents=data.documents(spark, held))
    got = mixing.query(spark, folder).collect()
    assert len(got) == len(held)
    size = Counter()
    for _, text, _, source, _ in held:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(dict(size))
    names = {r.doc_id: r for r in got}
    for doc_id, text, _, source, _ in held:
        if doc_id is not None:
            r = names[doc_id]
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and r.source_size == size[source]
            assert r.target == pytest.approx(want[source])
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    longest = max(r.size for r in got)
    budget = 1.5 * sum(size.values())
    assert budget - longest <= sum(r.taken for r in got) <= budget
    taken, goal = Counter(), {}
    for r in got:
        taken[r.target] += r.taken
        goal[r.target] = r.target
    assert all(abs(taken[t] - t) <= 2 * longest for t in goal)
    again = mixing.query(spark, folder).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_mixing_stage_repeats_rows(spark, tmp_root):
    held = data.rows(60, seed=22)
    df = data.documents(spark, held)
    folder = data.save(spark, tmp_root, documents=df)
    times = {r.doc_id: r.taken // r.size for r in mixing.query(spark, folder).collect()}
    out = mixing.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({i: n for i, n in times.items() if n})


def test_mixing_shapes(spark):
    rows = [(1, "a b", "en", None, 3), (2, None, "en", None, 0)]
    got = {r.row.doc_id: (r["size"], r.target) for r in mixing.mix(spark.createDataFrame(rows, data.SCHEMA)).collect()}
    assert got == {1: (2, 3.0), 2: (0, 3.0)}
    empty = spark.createDataFrame([], data.SCHEMA)
    assert mixing.mix(empty).count() == 0 and secrets.scan(empty).count() == 0
    assert mixing.stage(spark, empty, "").count() == 0 and secrets.stage(spark, empty, "").count() == 0
    assert quality.stage(spark, empty, "").count() == 0


PAGES = "page_id long, url string, html string"


def pages():
    out = []
    for i in range(240):
        tld, lang = ("org", "com", "net")[i % 3], ("en", "de", "fr", "es")[i // 3 % 4]
        tail = ("", ".html", "?page=2&ref=x", "#top", "/")[i % 5]
        out.append((i, f"https://www.Site{i % 7}.Example.{tld}/{lang}/{i}{tail}", "x"))
    out += [(900, None, "x"), (901, "", "x"), (902, "no scheme/here", "x"), (903, "http://org", "x"),
            (904, "http://example.org?x://y/z", "x"), (None, "ftp://a.example.org/en/1", "x"),
            (905, "http://a.notorg/fr/", "x"), (906, "x://EXAMPLE.ORG/es/#a?b", None), (0, out[0][1], "x")]
    return out


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return (host.translate({i: i + 32 for i in range(65, 91)}), re.match(r"[^?#]*", rest[len(host):])[0])


def test_url_rules_and_mined_verdicts(spark, tmp_root):
    df = spark.createDataFrame(pages(), PAGES).selectExpr("*", "1 AS tokens", "'v' AS verdict", "2 AS host")
    folder = data.save(spark, tmp_root, pages=df)
    got = urlfilter.query(spark, folder).collect()
    assert len(got) == len(pages())
    by_url = {}
    for page_id, url, _ in pages():
        host, path = plain_parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        by_url[(page_id, host, path)] = max(fits) if fits else None
    for r in got:
        best = by_url[(r.page_id, r.host, r.path)]
        assert r.rule == (best and best[1])
        if best:
            assert r.verdict == best[2]
        assert r.verdict in ("allow", "block")
    assert {r.verdict for r in got if r.page_id in (900, 901, 902)} == {"allow"}


def test_mined_rules_against_counting_all_subsets(spark):
    from itertools import combinations

    prepare(spark)
    rng = random.Random(1)
    held = []
    for _ in range(200):
        t = sorted(rng.sample("abcdef", rng.randint(1, 4)))
        held.append((t, "block" if {"a", "b"} <= set(t) or rng.random() < 0.1 else "allow"))
    classes, rules = urlfilter.mine(spark.createDataFrame(held, "tokens array<string>, verdict string"), support=0.05,
                                    confidence=0.7, longest=3)
    got = {(tuple(r.antecedent), r.verdict): (r.hits, round(r.confidence, 9)) for r in rules.collect()}
    want = {}
    for n in (1, 2, 3):
        for c in combinations("abcdef", n):
            seen = [v for t, v in held if set(c) <= set(t)]
            for v in ("allow", "block"):
                hits = seen.count(v)
                if hits >= 0.05 * len(held) and hits / len(seen) >= 0.7:
                    want[c, v] = (hits, round(hits / len(seen), 9))
    assert got == want
    sets = spark.createDataFrame([(t,) for t in {tuple(t) for t, _ in held}], "tokens array<string>")
    for r in urlfilter.decide(sets, classes, rules).collect():
        best = max((conf, hits, len(a), list(a), v) for (a, v), (hits, conf) in want.items() if set(a) <= set(r.tokens))
        assert r.mined == best[-1]


def test_urls_without_labels_or_rows(spark, tmp_root):
    some = spark.createDataFrame([(1, "http://x.net/a", "")], PAGES)
    assert [r.verdict for r in urlfilter.judge(some).collect()] == ["allow"]
    folder = data.save(spark, tmp_root, pages=spark.createDataFrame([], PAGES))
    assert urlfilter.query(spark, folder).count() == 0


def test_secrets_without_digits_and_beside_base_spans(spark):
    prepare(spark)
    mixed, capital = "kJxfQzxZavLmhPqRgtWbeYcNsdHs", "QZKVXJWBTGYHRMPFLDCNUAOIES"
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYZQ8hTkV2sL"
    texts = [f"key {mixed} end", f"key {capital} end", f"id AKIA{'Q7R2T9W4X6Y8Z3B5'}/{key} end",
             "donaudampfschifffahrtsgesellschaft Donaudampfschifffahrtsgesellschaft"]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], data.SCHEMA)
    left = {r.doc_id: r.text for r in secrets.stage(spark, df, "").collect()}
    assert left[0] == left[1] == "key [SECRET] end"
    assert key not in left[2] and left[2] == "id [SECRET][SECRET] end"
    assert left[3] == texts[3]


def test_mined_rules_of_five_tokens_decide(spark):
    """Only all five tokens together say block; every four of them are below the least confidence."""
    prepare(spark)
    held = [(list("abcde"), "block")] * 30
    held += [([t for t in "abcde" if t != x], "allow") for x in "abcde" for _ in range(10)]
    classes, rules = urlfilter.mine(spark.createDataFrame(held, "tokens array<string>, verdict string"))
    sets = spark.createDataFrame([(list("abcdef"),)], "tokens array<string>")
    assert [r.mined for r in urlfilter.decide(sets, classes, rules).collect()] == ["block"]


def test_template_tokens_are_one_item_and_verdicts_equal_those_of_all_subsets(spark):
    """Tokens with the same labelled rows are mined as one; urls that have only some of them still match."""
    from itertools import combinations

    prepare(spark)
    rng = random.Random(8)
    held = []
    for _ in range(150):
        t = {x for x in "uvw" if rng.random() < 0.5}
        t |= set(["q1", "q2", "q3"] if rng.random() < 0.5 else [])
        t |= set(["z1", "z2"] if rng.random() < 0.3 else [])
        block = ("q1" in t and "u" in t) or ("z1" in t and rng.random() < 0.9)
        held.append((sorted(t), "block" if block else "allow"))
    support, confidence = 0.05, 0.6
    classes, rules = urlfilter.mine(spark.createDataFrame(held, "tokens array<string>, verdict string"),
                                    support=support, confidence=confidence)
    assert {r.token: r["class"] for r in classes.collect()} == {
        **{x: x for x in "uvw"}, "q1": "q1", "q2": "q1", "q3": "q1", "z1": "z1", "z2": "z1"}
    names, want = ["q1", "q2", "q3", "u", "v", "w", "z1", "z2"], []
    for n in range(1, len(names) + 1):
        for c in combinations(names, n):
            seen = [v for t, v in held if set(c) <= set(t)]
            for v in ("allow", "block"):
                hits = seen.count(v)
                if hits >= support * len(held) and hits / len(seen) >= confidence:
                    want.append((hits / len(seen), hits, n, list(c), v))
    asked = [sorted(rng.sample(names + ["new"], rng.randint(1, 6))) for _ in range(80)]
    sets = spark.createDataFrame([(list(t),) for t in {tuple(t) for t in asked}], "tokens array<string>")
    got = {tuple(r.tokens): r.mined for r in urlfilter.decide(sets, classes, rules).collect()}
    for t in {tuple(t) for t in asked}:
        fits = [r for r in want if set(r[3]) <= set(t)]
        assert got.get(t) == (max(fits)[-1] if fits else None)


def test_thirty_shared_query_keys(spark):
    keys = "&".join(f"key{i}={{}}" for i in range(30))
    rows = [(i, f"https://a{i % 3}.com/{'fr' if i % 2 else 'de'}/x?{keys.format(*range(i, i + 30))}", "")
            for i in range(300)]
    rows.append((300, f"https://b.net/fr/?{keys.format(*range(30))}", ""))
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == ("allow" if i % 2 else "block") for i in range(300))
    assert got[300] == "allow"
