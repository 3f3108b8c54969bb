"""Sharding with a hierarchical weighted hash tree.

Shards are leaves of a tree of regions and racks; a rack weighs what its leaves weigh together, a
region what its racks do. A row descends level by level: at each node every child has a draw,
the exponential variable -ln(u) / weight with u from a hash of key and child, and the least draw
wins, so a child wins with the share of its weight. A row makes as many draws as the nodes on its
way have children, not as many as there are leaves.

When a leaf's weight changes, only the draws of that leaf, its rack and its region change, and each
in one direction: rows enter (or leave) the touched region, within it the touched rack, within
that the leaf. No row moves between two nodes of a level that the path doesn't touch. One more shard
comes as a region of its own, and so takes rows only into itself. The shard
depends on doc_id and the tree only.

Slots are numbered in two steps: equal rows (doc_id, checksum, size) are counted before the shuffle, the
counts by (shard, bucket) (shards x BUCKETS rows, whatever the corpus) give each bucket's offset, and a
window of running sums numbers the rows of one bucket. The bucket comes from doc_id and checksum, so an id that
repeats with many texts is spread, and one that repeats with one text is a single counted row.
Texts are measured where they are read and never shuffled.

Defined results: null text has 0 bytes (size 16, checksum 0); a null doc_id is a key of its
own; repeated rows get slots of their own, ties are broken by checksum and size; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


@dataclass(frozen=True)
class Tree:
    """`shards` leaves, `per_rack` to a rack and `racks` racks to a region; weights by leaf (1 where none is given).

    `alone` more leaves, numbered from `shards` on, are regions of their own.
    """

    shards: int
    per_rack: int = 5
    racks: int = 2
    weights: tuple[float, ...] = ()
    alone: int = 0

    def regions(self) -> list[list[list[tuple[int, float]]]]:
        """Leaves (number, weight) by region and rack."""
        leaves = [(i, self.weights[i] if i < len(self.weights) else 1.0) for i in range(self.shards + self.alone)]
        leaves, alone = leaves[: self.shards], leaves[self.shards :]
        racks = [leaves[i : i + self.per_rack] for i in range(0, len(leaves), self.per_rack)]
        return [racks[i : i + self.racks] for i in range(0, len(racks), self.racks)] + [[[leaf]] for leaf in alone]


def _literal(tree: Tree) -> Column:
    """The tree as nested arrays of (name, weight, children); a leaf has its number instead of children."""
    node = lambda kind, number, weight, below: F.struct(F.lit(f"{kind}{number}").alias("name"), F.lit(float(weight)).alias("weight"), below.alias("below"))
    regions, rack_number = [], 0
    for r, racks in enumerate(tree.regions()):
        below = []
        for rack in racks:
            below.append(node("rack", rack_number, sum(w for _, w in rack), F.array(*(node("shard", i, w, F.lit(i)) for i, w in rack))))
            rack_number += 1
        regions.append(node("region", r, sum(w for rack in racks for _, w in rack), F.array(*below)))
    return F.array(*regions)


def _winner(key: Column, children: Column) -> Column:
    """What lies below the child with the least draw; ties go to the child whose name is less."""

    def draw(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("/"), child["name"])), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 1.0) / float(1 << 52)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"), child["below"].alias("below"))

    return F.array_min(F.transform(children, draw))["below"]


def _descend(key: Column, tree: Tree) -> Column:
    """Shard of a row: by region, then by rack in it, then by leaf."""
    return _winner(key, _winner(key, _winner(key, _literal(tree))))


def place(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    grown = replace(tree, alone=tree.alone + 1)
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = measured.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")).select(
        "*",
        F.floor(F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), F.col("text_crc32").cast("string"))), 1, 3), 16, 10).cast("int") / (4096 // BUCKETS)).alias("bucket"),
        _descend(key, tree).cast("int").alias("shard"),
        _descend(key, grown).cast("int").alias("grown_shard"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("copies"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("base"))  # at most shards x BUCKETS rows
    own = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("end", F.sum("copies").over(own)).join(F.broadcast(offsets), ["shard", "bucket"])
    numbered = numbered.withColumn("slot", F.explode(F.sequence(F.col("base") + F.col("end") - F.col("copies"), F.col("base") + F.col("end") - 1)))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
