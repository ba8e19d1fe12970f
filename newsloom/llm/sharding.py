"""Sharding by a k-d tree over the documents' metadata.

A node that should become ``k`` shards is split where the weights (bytes) left of the cut make
``k // 2`` shards' worth, along the metadata dimension that is widest among its documents, until each leaf
has the target bytes. Dimensions are the text's size, language, source and id, each scaled to [0, 1).

Within one value of the widest dimension the order goes on by the text's checksum and then by a hash of the
id. So copies of a text stay together as long as the sizes allow, and a group of copies that is larger than
a shard is split all the same. A cut is found by a distributed radix search on the 60-bit order key: each round
sums bytes by the next 16 bits within every open node; one row for each node comes back to the driver. Rows carry the
number of their node from one level to the next in a written table, so a level reads it once for the widest dimensions
and once for each round, and the open nodes' parameters come as a table of one row a node.

Null and empty texts have no bytes (size 16), and texts may be of any length; null languages and sources are the empty string, null
ids 0 in the order. Each row gives one row, also if it repeats an id or has none. Equal keys fall on the same side of a cut. Of
equally wide dimensions the first is split. Without rows there are no rows in the result. Further columns, whatever their names, are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gapless_rank, small, staged

DIMENSIONS = ("size", "lang", "source", "doc_id")
VALUE_BITS, TEXT_BITS, ID_BITS, ROUND_BITS = 20, 24, 16, 16
KEY_BITS = VALUE_BITS + TEXT_BITS + ID_BITS
ROW_BYTES = 16


@dataclass
class Node:
    leaves: int
    bytes: int
    dimension: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a scaled whole number for each dimension; no text goes on from here."""
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    raw = staged(raw)
    r = raw.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("size").alias("s")).first()
    top = F.lit((1 << VALUE_BITS) - 1)
    low, width = r["a"] or 0, max(1, (r["b"] or 0) - (r["a"] or 0))
    scaled = (
        F.log1p("size") / F.log1p(F.lit(float(max(r["s"] or 1, 1)))),
        F.crc32("lang") / F.lit(float(1 << 32)),
        F.crc32("source") / F.lit(float(1 << 32)),
        F.coalesce((F.col("doc_id").cast("double") - float(low)) / float(width), F.lit(0.0)),
    )
    return raw.select("doc_id", "size", "text_crc32", *(F.least(F.greatest((x * top).cast("long"), F.lit(0)), top).alias(f"d{i}") for i, x in enumerate(scaled)))


def order_key(dimension: Column | str) -> Column:
    d = F.col(dimension) if isinstance(dimension, str) else dimension
    crc = F.shiftright(F.col("text_crc32"), 32 - TEXT_BITS)
    own = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << ID_BITS))
    return F.shiftleft(d, TEXT_BITS + ID_BITS).bitwiseOR(F.shiftleft(crc, ID_BITS)).bitwiseOR(own)


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def _with(rows: DataFrame, columns: str, values: list[tuple]) -> DataFrame:
    """``rows`` with the columns of their node: one row of ``values`` for each node, no more than there are shards."""
    return rows.join(small(rows.sparkSession.createDataFrame(values, f"node int, {columns}"), len(values)), "node")


def grow(rows: DataFrame, leaves: int) -> tuple[Node, DataFrame]:
    """The tree, and ``rows`` (from ``metadata``) with the number of their leaf in order, ``node``."""
    root = Node(leaves, rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    placed = rows.withColumn("node", F.lit(0))
    nodes = [root]
    while any(n.leaves > 1 for n in nodes):
        placed = staged(placed)
        open_ = {i: n for i, n in enumerate(nodes) if n.leaves > 1}
        ends = [f(f"d{k}").alias(f"{e}{k}") for k in range(len(DIMENSIONS)) for e, f in (("a", F.min), ("b", F.max))]
        spans = {r["node"]: r for r in placed.groupBy("node").agg(*ends).collect()}  # a row for each node
        for i, n in open_.items():
            width = [spans[i][f"b{k}"] - spans[i][f"a{k}"] for k in range(len(DIMENSIONS))] if i in spans else [0]
            n.dimension = width.index(max(width))
        _cut(placed, root, open_)
        nodes = _leaves(root)
        number = {id(n): i for i, n in enumerate(nodes)}
        moves = [(i, n.dimension, n.cut, number[id(n.left)], number[id(n.right)]) for i, n in open_.items()]
        moves += [(i, 0, 0, number[id(n)], number[id(n)]) for i, n in enumerate(_before(root, open_)) if i not in open_]
        moved = _with(placed, "dimension int, cut long, low int, high int", moves)
        placed = moved.withColumn("node", F.when(_key() < F.col("cut"), F.col("low")).otherwise(F.col("high"))).select(*rows.columns, "node")
    return root, placed


def _before(root: Node, open_: dict[int, Node]) -> list[Node]:
    """The leaves as they were before the nodes of ``open_`` were cut."""
    cut = {id(n) for n in open_.values()}

    def walk(n: Node) -> list[Node]:
        return [n] if n.left is None or id(n) in cut else walk(n.left) + walk(n.right)

    return walk(root)


def _key() -> Column:
    """A row's order key in the dimension of its node."""
    return order_key(F.element_at(F.array(*(f"d{i}" for i in range(len(DIMENSIONS)))), F.col("dimension") + 1))


def _cut(placed: DataFrame, root: Node, open_: dict[int, Node]) -> None:
    """Set the cuts of the open nodes and make their children."""
    goal = {i: n.bytes * (n.leaves // 2) / n.leaves for i, n in open_.items()}
    slack = max(1.0, root.bytes / root.leaves / 500)
    prefix, before, shift = dict.fromkeys(open_, 0), dict.fromkeys(open_, 0), KEY_BITS
    while prefix:
        bits = min(ROUND_BITS, shift)
        asked = [(i, open_[i].dimension, p, float(goal[i] - before[i])) for i, p in prefix.items()]
        keyed = _with(placed, "dimension int, prefix long, want double", asked).select("node", "size", "prefix", "want", _key().alias("key"))
        sums = (
            keyed.where(F.shiftright("key", shift) == F.col("prefix"))
            .groupBy("node", F.shiftright("key", shift - bits).alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.first("want").alias("want"))
        )
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))  # at most 2**ROUND_BITS rows a node
        found = sums.withColumn("upto", upto).where("upto >= want").groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto", "rows")).alias("x")).select("node", "x.*").collect()
        shift -= bits
        seen = {r["node"]: r for r in found}
        for i in list(prefix):
            r = seen.get(i)
            below = before[i] + (r["upto"] - r["bytes"] if r else 0)
            over = below + (r["bytes"] if r else 0)
            if r is None or r["bytes"] <= slack or r["rows"] == 1 or not shift:
                bin_ = r["bin"] if r else prefix[i]
                low = goal[i] - below <= over - goal[i]
                _split(open_[i], (bin_ if low else bin_ + 1) << shift, below if low else over)
                del prefix[i], before[i]
            else:
                prefix[i], before[i] = r["bin"], below


def _split(node: Node, cut: int, left_bytes: int) -> None:
    node.cut = cut
    node.left = Node(node.leaves // 2, left_bytes)
    node.right = Node(node.leaves - node.leaves // 2, node.bytes - left_bytes)


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Deal all documents into ``shards`` shards, or as many as have about ``target_bytes`` each:
    doc_id, size, text_crc32, shard, slot."""
    rows = staged(metadata(docs))
    if shards is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        shards = max(1, round(total / max(1, target_bytes or total or 1)))
    _, placed = grow(rows, shards)
    placed = placed.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    return gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", rows.count())
