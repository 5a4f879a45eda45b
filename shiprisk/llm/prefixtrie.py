"""Operator 11: the trie of conversation prefixes.

Turns are dictionary-encoded: distinct (role, text) pairs, by their SHA-256, are
numbered once, so texts never travel.  A conversation is then an array of numbers.
Conversations are range-sorted by (numbers, conv_id) into shards; every shard builds a
ternary search tree over its distinct sequences, inserted median first, which
keeps the trees of siblings balanced.  A walk back over the nodes (children have
higher numbers than their parents) accumulates members, leaves and savings.

A node occurs in several shards only on a shard's border: it is a prefix of the
shard's first or last sequence, shared with the neighbouring shard.  How many
leading turns neighbours share is known from one row a shard.  With it each
shard counts what is its own: the first shard of a node pays for its text and
tells its parent of a child, the last one decides whether it is a leaf.  So the
partial rows of border nodes only need adding up by node.  A shard has at most
twice its longest conversation of them.

Identical conversations, however many, are split over shards, as conv_id is the
last part of the range key.  Ids that end at a node are hashed in ascending
order; those of border nodes stream through the hash shard by shard, in blocks.
SHA-256 is sequential, so a node's last hash runs in one task, in bounded memory.
The turns of one conversation are held as one array of numbers, 12 bytes a turn.

Defined results: a null conv_id names no conversation, its rows are left out; a
null turn comes first, equal turns go by the SHA-256 of (role, text); null role
and text are empty; repeated rows are turns of their own; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiprisk.llm.common import materialise, prepare, table, text_or_empty
from shiprisk.session import parallelism

FAMILY = 100
HEADS = 6
#: Turns a shard is planned for.
SHARD_TURNS = 100_000
#: Ids in one block on their way to a border node's hash.
BLOCK = 4_096

NODE = ("part int, node binary, border boolean, parent binary, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends array<string>")


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id and its turns in order: numbers and code points of the texts."""
    role, text = text_or_empty("role"), text_or_empty("text")
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", name.alias("name"), F.length(text).alias("chars"))
    rows = materialise(rows, "trie-turns")
    # Numbers rise with the digests, whatever the partitions, so equal turns keep their order.
    names = rows.select("name").distinct().repartitionByRange("name").sortWithinPartitions("name").select(
        "name", F.monotonically_increasing_id().alias("code"))
    coded = rows.join(materialise(names, "trie-names"), "name")
    held = F.sort_array(F.collect_list(F.struct("turn", "code", "chars")))
    return coded.groupBy("conv_id").agg(held.alias("turns")).select(
        "conv_id", F.col("turns.code").alias("codes"), F.col("turns.chars").alias("chars"))


def rebuilt(held: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Every conversation after the first turns of its family's first one (crc32 of its id says how many)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = held.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"base_{c}") for c in ("codes", "chars")])
    both = held.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(
        first, "base", "left")
    none = lambda c: F.array().cast(held.schema[c].dataType)
    return both.select("conv_id", *[F.concat(
        F.slice(F.coalesce(f"base_{c}", none(c)), 1, F.col("h")),
        F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c) for c in ("codes", "chars")])


class Tree:
    """A trie whose children of a node form a search tree: lower, higher, and down to the next turn."""

    def __init__(self):
        self.code, self.lower, self.higher, self.down, self.parent, self.chars = [-1], [-1], [-1], [-1], [-1], [0]

    def _new(self, code: int, chars: int, parent: int) -> int:
        for column, value in zip((self.code, self.lower, self.higher, self.down, self.parent, self.chars),
                                 (code, -1, -1, -1, parent, chars)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], chars: list[int]) -> int:
        """The node of a sequence; nodes on the way are made where they are missing."""
        node = 0
        for code, length in zip(codes, chars):
            at, side, where = self.down[node], self.down, node
            while at >= 0 and self.code[at] != code:
                side, where = (self.lower if code < self.code[at] else self.higher), at
                at = side[where]
            if at < 0:
                at = side[where] = self._new(code, length, node)
            node = at
        return node

    def path(self, node: int) -> list[int]:
        """Nodes from the root to a node."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every span before its halves."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            mid = (a + b) // 2
            yield mid
            spans += [(a, mid), (mid + 1, b)]


def blocks(ids: np.ndarray) -> list[str]:
    return [",".join(map(str, ids[i:i + BLOCK].tolist())) for i in range(0, len(ids), BLOCK)]


def shard_nodes(part: int, ids: np.ndarray, codes: list[list[int]], chars: list[np.ndarray], shared_before: int, shared_after: int
                ) -> pd.DataFrame:
    """NODE rows of one shard: conversations in (codes, conv_id) order, at least one.

    ``shared_before`` and ``shared_after`` are the leading turns that the first and
    last sequence share with the neighbouring shards, -1 where there is none.
    """
    starts = [0] + [i for i in range(1, len(ids)) if codes[i] != codes[i - 1]]
    stops = [*starts[1:], len(ids)]
    tree, ends = Tree(), {}
    for k in medians(len(starts)):
        at = starts[k]
        ends[tree.insert(codes[at], chars[at].tolist())] = (at, stops[k])
    n = len(tree.code)
    members, least, depth = [0] * n, [None] * n, [0] * n
    for node, (a, b) in ends.items():
        members[node], least[node] = b - a, int(ids[a])
    for node in range(1, n):
        depth[node] = depth[tree.parent[node]] + 1
    first = tree.path(next(v for v, (a, _) in ends.items() if a == 0))
    last = tree.path(next(v for v, (_, b) in ends.items() if b == len(ids)))
    earlier, later = set(first[:shared_before + 1]), set(last[:shared_after + 1])
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    has_child = [False] * n
    for node in reversed(range(n)):  # children before their parents
        new = node not in earlier
        if not has_child[node] and node not in later:
            leaves[node] += 1
        saved[node] += tree.chars[node] * (members[node] - new)
        up = tree.parent[node]
        if up >= 0:
            has_child[up] = True
            children[up] += new
            members[up] += members[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
    border, digest = earlier | later, hashlib.sha256()
    names = {}
    for path in (first, last):
        digest = hashlib.sha256()
        for node in path:
            if node not in border:
                break
            digest.update(int(tree.code[node]).to_bytes(8, "little", signed=True))
            names[node] = digest.digest()
    empty, rows = hashlib.sha256().hexdigest(), []
    for node in range(n):
        a, b = ends.get(node, (0, 0))
        held = blocks(ids[a:b]) if node in border else None
        sha = None if node in border else hashlib.sha256(",".join(
            map(str, ids[a:b].tolist())).encode()).hexdigest() if b > a else empty
        up = tree.parent[node]
        rows.append((part, names.get(node), node in border, names.get(up), least[node], depth[node],
                     least[up] if up >= 0 and up not in border else None, members[node], children[node], leaves[node],
                     saved[node], sha, held))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")], dtype=object)


def fences(sorted_rows: DataFrame) -> DataFrame:
    """part -> leading turns shared with the shard before and the one after (-1: there is none)."""
    order = F.struct("codes", "conv_id")
    per = sorted_rows.groupBy("part").agg(
        F.min_by("codes", order).alias("first"), F.max_by("codes", order).alias("last"))
    by = Window.orderBy("part")  # one row a shard

    def shared(a, b):
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        differs = F.array_position(same, F.lit(False)).cast("int")
        return F.when(a.isNull() | b.isNull(), -1).when(differs > 0, differs - 1).otherwise(F.size(same))

    before, after = F.lag("last").over(by), F.lead("first").over(by)
    return per.select("part", shared(before, F.col("first")).alias("shared_before"),
                      shared(F.col("last"), after).alias("shared_after"))


def streamed_digests(border: DataFrame) -> DataFrame:
    """Border nodes' blocks of ids, in shard order -> node, ends_sha256; a block at a time is in memory."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, held = None, None
        for batch in batches:
            done = []
            for key, block in zip(batch["node"], batch["block"]):
                if key != node:
                    if held is not None:
                        done.append((node, held.hexdigest()))
                    node, held = key, hashlib.sha256(block.encode())
                else:
                    held.update(b"," + block.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if held is not None:
            yield pd.DataFrame([(node, held.hexdigest())], columns=["node", "ends_sha256"])

    pieces = border.select("node", "part", F.posexplode("ends").alias("at", "block"))
    return pieces.repartition("node").sortWithinPartitions("node", "part", "at").select("node", "block").mapInPandas(
        digest, "node binary, ends_sha256 string")


def trie(turns: DataFrame, *, family: int = FAMILY, heads: int = HEADS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, turn, role, text) rows -> one row per node of the trie of rebuilt conversations."""
    spark = prepare(turns.sparkSession)
    held = materialise(rebuilt(encoded(turns), family, heads), "trie-conversations")
    total = held.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    shards = max(parallelism(spark), -(-total // shard_turns))
    dealt = held.repartitionByRange(shards, "codes", "conv_id").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "trie-shards")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip((c.tolist() for c in group["codes"]), group["conv_id"].tolist(), group["chars"]),
                      key=lambda r: r[:2])
        codes, ids, chars = zip(*rows)
        return shard_nodes(int(group["part"].iat[0]), np.array(ids, np.int64), list(codes), list(chars),
                           int(group["shared_before"].iat[0]), int(group["shared_after"].iat[0]))

    # The fences are a row a shard, so they may be sent to all tasks.
    nodes = dealt.join(F.broadcast(fences(dealt)), "part").groupBy("part").applyInPandas(build, NODE)
    nodes = materialise(nodes, "trie-nodes")
    border = nodes.filter("border")
    merged = border.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("parent").alias("parent"))
    merged = materialise(merged, "trie-border")
    mins = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_min"))
    empty = hashlib.sha256().hexdigest()
    of_border = merged.join(mins, "parent", "left").join(streamed_digests(border), "node", "left").select(
        "conv_id", "depth", F.col("parent_min").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    # A shard's own copy of its border nodes' least members, so children of one hot parent join shard by shard.
    local = border.select("part", "node").join(merged.select("node", "conv_id"), "node").select(
        "part", F.col("node").alias("parent"), F.col("conv_id").alias("parent_min"))
    inner = nodes.filter("not border").join(local, ["part", "parent"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "parent_min").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return of_border.union(inner)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = """
WITH step AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
coded AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS code
  FROM conversations WHERE conv_id IS NOT NULL),
held AS (
  SELECT conv_id, list(code ORDER BY turn NULLS FIRST, code) AS codes,
         list(chars ORDER BY turn NULLS FIRST, code) AS chars
  FROM coded GROUP BY conv_id),
counted AS (
  SELECT held.*, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                                lambda x: CAST(ascii(x) AS BIGINT)),
                                 lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM held, step),
rebuilt AS (
  SELECT c.conv_id, coalesce(list_slice(b.codes, 1, h), []) || list_slice(c.codes, h + 1, len(c.codes)) AS codes,
         coalesce(list_slice(b.chars, 1, h), []) || list_slice(c.chars, h + 1, len(c.chars)) AS chars
  FROM counted c LEFT JOIN held b ON b.conv_id = c.conv_id - c.conv_id % 100),
member AS (SELECT *, unnest(range(0, len(codes) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, list_slice(codes, 1, depth) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END) AS chars,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(codes) = depth), '')
           AS ends
  FROM member GROUP BY 1, 2),
kids AS (
  SELECT depth - 1 AS depth, list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM nodes WHERE depth > 0
  GROUP BY 1, 2),
full_nodes AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes
  LEFT JOIN kids ON kids.depth = nodes.depth AND kids.path = nodes.path),
above AS (SELECT path, n_convs, chars, n_children, unnest(range(0, depth + 1)) AS k FROM full_nodes),
sums AS (
  SELECT k AS depth, list_slice(path, 1, k) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((n_convs - 1) * chars) AS saved_tokens
  FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""
