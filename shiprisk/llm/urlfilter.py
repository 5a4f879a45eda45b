"""Operator 6: URL filters from host and path rules, completed by association rules.

Listed rules decide the urls they fit (the longest fitting rule wins).  Their
verdicts are the labels from which Spark's FP-growth mines the token
combinations of urls: host labels, path segments by place, file extension,
query keys, fragment.  Rules ``tokens -> verdict`` below the least support or
confidence are pruned; rules have no greatest length.

Tokens that occur in the same labelled rows (the keys of a query template, say)
are one class, and FP-growth mines classes: k such tokens are one item, not 2**k
itemsets, and no rule is lost, as every choice of a class' tokens has the same
support and confidence.  The classes come from a row-set digest per token, an
aggregate; tokens below the least support are in no rule and in no class.

Rules match by an inverted index: every rule is filed under its rarest class, a
token set meets only the rules filed under its classes, and the rule's other
classes are then looked up.  A rule stands for all its tokens that the url
has.  The rule with the highest confidence, then support, then number of tokens
decides; without any the verdict is ``allow``.

Verdicts depend on the token set alone, so rows are reduced to distinct token
sets (numbers count as one token) before the index join.

Defined results: a null url, or one without ``://``, has an empty host and path
and no tokens, hence no rule and verdict allow; a null page_id is passed on;
repeated rows are judged alike; without labelled urls every verdict that no
listed rule makes is allow; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.llm.common import materialise, table

# Fixed values of the contract: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
LEAST_SUPPORT = 0.01
LEAST_CONFIDENCE = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """(length, rule, verdict) of the longest fitting rule, or null."""
    fits = []
    for verdict, h, p in rules:
        at_host = (host == h) | host.endswith("." + h)
        fits.append(F.when(at_host & path.startswith(p), F.struct(
            F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens of a url; an all-digit segment counts as ``9``."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    bare = F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x, i: F.concat(
        F.lit("p"), i.cast("string"), F.lit(":"), F.when(x.rlike("^[0-9]+$"), F.lit("9")).otherwise(x)))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    extra = F.array(
        F.when(extension != "", F.concat(F.lit("x:"), F.lower(extension))),
        F.when(path.endswith("/"), F.lit("end:/")), F.when(F.contains(url, F.lit("#")), F.lit("f:#")))
    asked = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    asked = F.transform(asked, lambda x: F.concat(F.lit("q:"), x))
    every = F.concat(labels, segments, F.filter(extra, lambda x: x.isNotNull()), asked)
    return F.array_sort(F.array_distinct(F.when(host != "", every).otherwise(F.array().cast("array<string>"))))


def token_classes(labelled: DataFrame, support: float = LEAST_SUPPORT) -> DataFrame:
    """(tokens, verdict) rows -> (token, class): frequent tokens, named after the least of those with their rows.

    A token's rows are told by their number and the sums of two hashes of their
    row numbers.  Rows hold few tokens, so at most (tokens a row) / support are
    frequent, however many rows there are.
    """
    n = labelled.count()
    rows = labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), "row_no")
    digest = [F.sum(F.xxhash64("row_no", F.lit(seed)).cast("decimal(38,0)")).alias(f"d{seed}") for seed in (1, 2)]
    seen = rows.groupBy("token").agg(F.count("*").alias("seen"), *digest).filter(F.col("seen") >= F.lit(n * support))
    same = seen.groupBy("seen", "d1", "d2").agg(F.min("token").alias("class"), F.collect_list("token").alias("tokens"))
    return same.select(F.explode("tokens").alias("token"), "class")


def classed(token_sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``items`` to rows with ``tokens``: each frequent class in them, with its tokens there, sorted.

    The table of classes has a bounded number of rows (see token_classes), so it goes to all tasks as one map.
    """
    held = classes.agg(F.map_from_entries(F.collect_list(F.struct("token", "class"))).alias("class_of"),
                       F.lit(1).alias("one"))
    with_map = token_sets.withColumn("one", F.lit(1)).join(F.broadcast(held), "one")  # one row
    known = F.filter("tokens", lambda t: F.map_contains_key("class_of", t))
    pairs = F.transform(known, lambda t: F.struct(F.element_at("class_of", t).alias("class"), t.alias("token")))
    return with_map.withColumn("items", F.array_sort(pairs)).drop("class_of", "one")


def mine(labelled: DataFrame, *, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE,
         longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens, verdict) rows -> token classes, and pruned rules (antecedent, verdict, confidence, hits, anchor).

    Antecedents are arrays of classes; ``longest`` bounds them (for tests).
    """
    mark = "verdict="
    labelled = materialise(labelled.select("tokens", "verdict", F.monotonically_increasing_id().alias("row_no")),
                           "url-labelled")
    classes = materialise(token_classes(labelled, support), "url-classes")
    baskets = classed(labelled, classes).select(F.concat(
        F.array_distinct(F.transform("items", lambda x: x["class"])),
        F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    sets = materialise(sets, "url-itemsets")
    is_mark = lambda x: x.startswith(mark)
    plain = sets.filter(~F.exists("items", is_mark)).select(F.array_sort("items").alias("antecedent"),
                                                            F.col("freq").alias("seen"))
    fits = F.size("items") >= 2 if longest is None else F.size("items").between(2, longest + 1)
    ruled = sets.filter(F.exists("items", is_mark) & fits).select(
        F.array_sort(F.filter("items", lambda x: ~is_mark(x))).alias("antecedent"),
        F.substring_index(F.array_max(F.filter("items", is_mark)), mark, -1).alias("verdict"),
        F.col("freq").alias("hits"))
    rules = ruled.join(plain, "antecedent").withColumn("confidence", F.col("hits") / F.col("seen")).filter(
        F.col("confidence") >= confidence)
    single = plain.filter(F.size("antecedent") == 1).select(F.element_at("antecedent", 1).alias("class"), "seen")
    each = rules.select("antecedent", "verdict", "confidence", "hits", F.explode("antecedent").alias("class"))
    filed = each.join(single, "class").groupBy("antecedent", "verdict", "confidence", "hits").agg(
        F.min_by("class", F.struct("seen", "class")).alias("anchor"))
    return classes, materialise(filed, "url-rules")


def decide(token_sets: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (column tokens) -> (tokens, mined) for those that a rule matches."""
    asked = classed(token_sets, classes).withColumn("held", F.array_distinct(
        F.transform("items", lambda x: x["class"])))
    met = asked.withColumn("anchor", F.explode("held")).join(rules, "anchor").filter(
        F.size(F.array_except("antecedent", "held")) == 0)
    inside = F.array_sort(F.transform(
        F.filter("items", lambda x: F.array_contains("antecedent", x["class"])), lambda x: x["token"]))
    order = F.struct("confidence", "hits", F.size(inside).alias("length"), inside.alias("tokens_met"), "verdict")
    return met.groupBy("tokens").agg(F.max_by("verdict", order).alias("mined"))


def judge(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """page_id, url rows -> page_id, host, path, rule, verdict."""
    seen = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url_text"))
    host, path = host_and_path(F.col("url_text"))
    seen = seen.withColumn("host", host).withColumn("path", path)
    seen = seen.withColumn("fit", listed(F.col("host"), F.col("path"), rules)).withColumn(
        "tokens", tokens(F.col("host"), F.col("path"), F.col("url_text")))
    seen = materialise(seen.drop("url_text"), "urls")
    labelled = seen.filter("fit is not null").select("tokens", F.col("fit.verdict").alias("verdict"))
    out = seen.withColumn("mined", F.lit(None).cast("string"))
    if not labelled.isEmpty():
        sets = seen.filter("fit is null and size(tokens) > 0").select("tokens").distinct()
        out = seen.join(decide(sets, *mine(labelled)), "tokens", "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                      F.coalesce("fit.verdict", "mined", F.lit(DEFAULT)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
