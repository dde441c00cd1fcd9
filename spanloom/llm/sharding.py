"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

A topology is a tree of regions, racks and shards with weights; a node weighs what its shards weigh together. A
row descends from the root: at each level every child draws -ln(u) / weight, with u in (0, 1) from a hash of the
row's key and the child's name, and the smallest draw wins (weighted rendezvous within one node's children). A
draw depends on nothing but the key, the child and its weight, so a change of weights moves rows only into or out
of the subtrees whose weights change, and nothing moves inside a subtree whose weights stay.

Growth opens a region of its own for each shard beyond the planned ones: the new region is a new child of the
root, so it can only win rows that another region held, and it holds one shard. That is the `key` law: key and
shard count decide, and one more shard takes rows only into itself.

Slots number the rows of a shard without gaps: rows are numbered inside hash slices of each shard, and a small table
of slice sizes gives each slice its first slot, so no shard is sorted in one task.

Defined cases: a null key is a key of its own (all such rows share a shard); a null text has size 8 and CRC 0;
repeated rows share a shard and get slots of their own, in arbitrary order among themselves; an empty table gives
an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a shard that are numbered together.
SLICE_ROWS = 50_000
LEAST_SLICES = 32


@dataclass(frozen=True)
class Topology:
    """Regions of racks of shards: {region: {rack: {shard: weight}}}; shard numbers are unique."""

    tree: dict[str, dict[str, dict[int, float]]]

    @staticmethod
    def planned(shards: int, planned: int = 24, racks: int = 3, per_rack: int = 4) -> Topology:
        """Equal shards: the planned ones in full regions, each later one in a region of its own."""
        tree: dict[str, dict[str, dict[int, float]]] = {}
        for i in range(shards):
            if i < planned:
                region, rack = i // (racks * per_rack), i // per_rack % racks
                tree.setdefault(f"region-{region}", {}).setdefault(f"region-{region}/rack-{rack}", {})[i] = 1.0
            else:
                tree[f"later-{i}"] = {f"later-{i}/rack-0": {i: 1.0}}
        return Topology(tree)

    def weight(self, region: str, rack: str | None = None) -> float:
        racks = self.tree[region]
        return sum(sum(s.values()) for r, s in racks.items() if rack in (None, r))


def draw(key: Column, node: str, weight: float) -> Column:
    """Exponential draw of a node for a key: small wins, more often for a larger weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float]]) -> Column:
    """Index of the child with the smallest draw."""
    children = [c for c in children if c[1] > 0]
    if len(children) == 1:
        return F.lit(0)
    draws = [F.struct(draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight) in enumerate(children)]
    return F.array_min(F.array(*draws))["i"]


def place(df: DataFrame, topology: Topology, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """df with the shard of each row's key; one level of the tree is one column step."""
    k = F.col(f"`{key}`")
    tree = {r: {q: {s: w for s, w in shards.items() if w > 0} for q, shards in racks.items()} for r, racks in topology.tree.items()}
    tree = {r: {q: s for q, s in racks.items() if s} for r, racks in tree.items()}
    tree = {r: racks for r, racks in tree.items() if racks}
    if not tree:
        raise ValueError("no shard has a weight")
    regions = [(r, topology.weight(r)) for r in tree]
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]

    def pick(at: Column, choices: list[Column]) -> Column:
        return reduce(lambda rest, i: F.when(at == i, choices[i]).otherwise(rest), range(len(choices) - 2, -1, -1), choices[-1])

    df = df.select(*kept, _winner(k, regions).alias("__region"))
    racks = [_winner(k, [(q, sum(s.values())) for q, s in tree[r].items()]) for r, _ in regions]
    df = df.select(*kept, "__region", pick(F.col("__region"), racks).alias("__rack"))

    def shard_of(shards: dict[int, float]) -> Column:
        names = list(shards)
        index = _winner(k, [(f"shard-{s}", w) for s, w in shards.items()])
        return F.element_at(F.array(*[F.lit(s) for s in names]), index + 1)

    leaves = [pick(F.col("__rack"), [shard_of(s) for s in tree[r].values()]) for r, _ in regions]
    return df.select(*kept, pick(F.col("__region"), leaves).cast("int").alias(out))


def number(df: DataFrame, key: str = "doc_id", shard: str = "shard", out: str = "slot") -> DataFrame:
    """df with the row's number in its shard, from 0 without gaps."""
    shards = 24
    slices = max(LEAST_SLICES, df.count() // (SLICE_ROWS * shards) + 1)
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    sliced = df.select(*kept, F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("slice")), F.lit(slices)).cast("int").alias("__slice"))
    inside = sliced.withColumn("__row", F.row_number().over(Window.partitionBy(shard, "__slice").orderBy(F.col(f"`{key}`").asc_nulls_last())))
    sizes = sliced.groupBy(F.col(shard).alias("__of"), F.col("__slice").alias("__in")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__of").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__of", "__in", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    joined = inside.join(first, (F.col(shard) == F.col("__of")) & (F.col("__slice") == F.col("__in")))
    return joined.select(*kept, (F.col("__first") + F.col("__row") - 1).cast("long").alias(out))


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 5: all documents into 24 shards, and where they go when there is one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(place(docs, Topology.planned(24)), Topology.planned(25), out="grown_shard")
    return number(placed).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
