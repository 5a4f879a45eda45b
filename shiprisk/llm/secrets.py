"""Operator 4: secret scans with a randomness test battery, in native expressions only.

Base spans come from three fixed patterns.  The method adds strings that pass
for random: a candidate is a run of 20 or more code letters that holds a letter
and either a digit, a capital after a small letter, or capitals alone; of a run
that touches base spans, the parts outside them are judged by the same rule.
Runs of small letters alone, or of capitals followed by small letters (plain
words), are no candidates.  Its encoding (hex, base32, lower or upper alphanumeric, base64)
is inferred from its letters, and three tests of the hypothesis "uniformly
random over that alphabet" are made: chi-squared uniformity (Wilson-Hilferty
tail), Wald-Wolfowitz runs about the middle of the alphabet, and lag-one serial
correlation.  The Bonferroni minimum of the three is the candidate's p-value.
Within a text a Benjamini-Hochberg step with weights in proportion to length
(long strings have more power) controls the false discoveries among the
strings called non-random; those are dropped, the others become ``random``
spans.

Everything happens inside a row: no shuffle, no join, no Python.  Positions
are code points, taken from the lengths of the pieces between matches.

Defined results: a null or empty text has no spans (the digest of the empty
string); a null doc_id is passed on; repeated rows are judged alike; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.llm.common import table, text_or_empty

# Fixed values of the contract: the three base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6

KINDS = ("assign", "access", "hex", "random")

#: A run of code letters, 20 or more, that holds a digit, or a capital after a small letter, or no small letter.
CANDIDATE = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Z+/_-]*+[a-z][a-z+/_-]*+[A-Z]|[A-Z+/_-]++(?![a-z]))"
             r"[A-Za-z0-9+/_-]{20,}+={0,2}")

ALPHA = 0.01

# Alphabets, in the order in which they are tried.
ALPHABETS = {
    "^[0-9a-fA-F]+$": "0123456789abcdef",
    "^[A-Z2-7]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "^[0-9a-z]+$": "0123456789abcdefghijklmnopqrstuvwxyz",
    "^[0-9A-Z]+$": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_SPAN = "struct<start:int,kind_no:int,stop:int,word:string>"


def _matches(text: Column, pattern: str, kind_no: int, needs: Column | None = None) -> Column:
    """All matches of a pattern that matches no empty text, as spans with code-point positions.

    ``needs`` is a cheap condition that holds for every text with a match.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["piece"])
        stop = at + F.length(pair["word"])
        span = F.struct(at.alias("start"), F.lit(kind_no).alias("kind_no"), stop.alias("stop"),
                        pair["word"].alias("word"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found,
                       lambda p, w: F.struct(p.alias("piece"), w.alias("word")))
    spans = F.aggregate(pairs, start, step)["out"]
    found_any = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(found_any, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _upper_tail(z: Column) -> Column:
    """Standard normal upper tail (a rational approximation, error under 1e-7)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    # The coefficients of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def _alphabet(word: Column) -> Column:
    out = None
    for pattern, letters in ALPHABETS.items():
        out = F.when(word.rlike(pattern), F.lit(letters)) if out is None else out.when(
            word.rlike(pattern), F.lit(letters))
    return out.otherwise(F.lit(BASE64))


def _coded(word: Column) -> Column:
    """(letters, alphabet) of a candidate: no padding, one case for hex, one base64 variant."""
    bare = F.regexp_replace(word, "=+$", "")
    alphabet = _alphabet(bare)
    letters = F.when(bare.rlike("^[0-9a-fA-F]+$"), F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    return F.struct(letters.alias("letters"), alphabet.alias("alphabet"))


def p_value(word: Column) -> Column:
    """Battery p-value of "uniformly random over the inferred alphabet"."""
    def bind(value: Column, body):
        """Evaluate ``value`` once and use it in ``body`` (a let-binding)."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def with_coded(coded: Column) -> Column:
        chars = F.split(coded["letters"], "")
        values = F.transform(chars, lambda c: (F.position(c, coded["alphabet"]) - 1).cast("double"))
        squares = F.aggregate(
            F.transform(F.split(coded["alphabet"], ""), lambda c: F.length(coded["letters"]) - F.length(
                F.replace(coded["letters"], c, F.lit("")))),
            F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        return bind(F.struct(values.alias("v"), F.length(coded["alphabet"]).cast("double").alias("k"),
                             F.length(coded["letters"]).cast("double").alias("n"), squares.alias("squares")), tests)

    def tests(s: Column) -> Column:
        n, k, v = s["n"], s["k"], s["v"]
        df = k - 1
        chi2 = s["squares"] * k / n - n
        width = F.lit(2.0) / (df * 9)
        p_chi = _upper_tail((F.cbrt(F.greatest(chi2, F.lit(0.0)) / df) - (F.lit(1.0) - width)) / F.sqrt(width))
        high = F.transform(v, lambda x: (x >= k / 2).cast("int"))
        ahead, behind = lambda a: F.slice(a, F.lit(2), F.size(a) - 1), lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
        zero = F.lit(0.0)
        ups = F.aggregate(high, zero, lambda acc, x: acc + x)
        runs = F.aggregate(F.zip_with(behind(high), ahead(high), lambda a, b: (a != b).cast("int")),
                           F.lit(1.0), lambda acc, x: acc + x)
        mean, var = (k - 1) / 2, (k * k - 1) / 12
        serial = F.aggregate(F.zip_with(behind(v), ahead(v), lambda a, b: (a - mean) * (b - mean)),
                             zero, lambda acc, x: acc + x) / (F.sqrt(n - 1) * var)
        p_serial = _upper_tail(F.abs(serial)) * 2
        return bind(F.struct(ups.alias("ups"), (n - ups).alias("downs"), runs.alias("runs")),
                    lambda r: F.least(F.lit(1.0), F.least(p_chi, p_serial, runs_test(r, n)) * 3))

    def runs_test(r: Column, n: Column) -> Column:
        both = r["ups"] * r["downs"] * 2
        var = both * (both - n) / (n * n * (n - 1))
        z = (r["runs"] - (both / n + 1)) / F.sqrt(F.greatest(var, F.lit(1e-12)))
        return F.when((both == 0) | (var <= 0), F.lit(0.0)).otherwise(_upper_tail(F.abs(z)) * 2)

    return bind(_coded(word), with_coded)


def _random(candidates: Column, alpha: float) -> Column:
    """The candidates that the length-weighted Benjamini-Hochberg step doesn't call non-random."""
    tested = F.transform(candidates, lambda c: F.struct(c.alias("span"), p_value(c["word"]).alias("p"),
                                                        F.length(c["word"]).cast("double").alias("n")))

    def keep(rows: Column) -> Column:
        m = F.size(rows).cast("double")
        mean = F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x["n"]) / m
        weighed = F.transform(rows, lambda x: x["p"] * mean / x["n"])
        ordered = F.array_sort(weighed)
        passing = F.filter(F.transform(ordered, lambda q, i: F.when(q <= F.lit(alpha) * (i + 1) / m, q)),
                           lambda q: q.isNotNull())
        limit = F.coalesce(F.array_max(passing), F.lit(-1.0))
        return F.transform(F.filter(rows, lambda x: x["p"] * mean / x["n"] > limit), lambda x: x["span"])

    return F.when(F.size(candidates) > 0, F.element_at(F.transform(F.array(tested), keep), 1)
                  ).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _outside(c: Column, base: Column) -> Column:
    """The parts of a candidate outside the base spans (ordered by start) that are candidates themselves."""
    touching = F.filter(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))

    def part(start: Column, stop: Column) -> Column:
        word = F.substring(c["word"], start - c["start"] + 1, F.greatest(stop - start, F.lit(0)))
        return F.struct(start.alias("start"), c["kind_no"].alias("kind_no"), stop.alias("stop"), word.alias("word"))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"),
                        F.concat(acc["out"], F.array(part(acc["at"], b["start"]))).alias("out"))

    start = F.struct(c["start"].alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    parts = F.aggregate(touching, start, step, lambda acc: F.concat(
        acc["out"], F.array(part(acc["at"], c["stop"]))))
    return F.when(F.size(touching) == 0, F.array(c)).otherwise(
        F.filter(parts, lambda p: p["word"].rlike(f"^{CANDIDATE}$")))


def scan(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None,
         alpha: float = ALPHA) -> DataFrame:
    """Carried columns (in struct ``row``), the text, and the sorted spans: base and all.

    A span is (start, kind_no, stop, word); kind_no counts KINDS.
    """
    carry = ["doc_id"] if carry is None else carry
    t = F.col("scanned")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text_or_empty(text).alias("scanned"))
    long_enough = lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= ASSIGN_LEAST
    has = lambda part: F.contains(t, F.lit(part))
    out = out.select("row", "scanned",
                     F.filter(_matches(t, ASSIGN, 0, has(":") | has("=")), long_enough).alias("assign"),
                     _matches(t, ACCESS, 1, has("AKIA")).alias("access"), _matches(t, HEX, 2).alias("hex"),
                     _matches(t, CANDIDATE, 3).alias("candidates"))
    out = out.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    has_letter = lambda c: c["word"].rlike("[A-Za-z]")
    outside = F.flatten(F.transform("candidates", lambda c: _outside(c, F.col("base"))))
    out = out.withColumn("candidates", F.filter(
        F.when((F.size("base") > 0) & (F.size("candidates") > 0), outside).otherwise(F.col("candidates")), has_letter))
    out = out.withColumn("random", _random(F.col("candidates"), alpha))
    return out.withColumn("spans", F.array_sort(F.concat("base", "random")))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind_no"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Adds ``masked``: the scanned text with every span (overlaps merged) replaced by ``mark``."""
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] > s["start"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                             F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))))
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))))
    found = found.withColumn("cuts", F.when(F.size("spans") > 0, merged))
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["stop"]))
    stops = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length("scanned")))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring(F.col("scanned"), a + 1, b - a))
    return found.withColumn("masked", F.when(F.size("spans") > 0, F.array_join(pieces, mark)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; its secrets are masked (n_chars follows the new text)."""
    cols = docs.columns
    out = mask(scan(docs, carry=cols))
    new = {"text": F.coalesce(F.col("masked"), F.col("row.text"))}
    if "n_chars" in cols:
        new["n_chars"] = F.when(F.col("masked").isNull(), F.col("row.n_chars")).otherwise(
            F.length("masked").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols])
