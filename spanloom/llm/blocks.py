"""Blocks of documents, and counting of hashed features across all of them in packed form.

Billions of windows or shingles are counted without a row for each. Documents are hashed into blocks; a block
computes the hashed features of its texts and ships, for each bucket of the hash space, one row that holds the
sorted distinct fingerprints of the block as packed bytes (delta-coded byte planes, which the shuffle's compression
shrinks to a few bytes for each feature). A bucket merges the fingerprints of all blocks and answers every block
with one row of flags in the same order, so nothing but flags comes back. Equal features of one block are merged
before the shuffle, so a feature that is in a third of all documents costs a bucket one entry for each block.

Fingerprints are a filter, not an identity: their width follows the number of features, and whatever passes is
compared by wider hashes afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_ranks, estimated_bytes, memory_for, sorted_unique, trim

#: Bytes of estimated input in one block, and features in one bucket.
BLOCK_BYTES = 3 << 19
#: Blocks that share a partition, on average.
PER_PARTITION = 2
#: Spare bits of a fingerprint over the logarithm of the number of features: false flags stay below 2 ** -SPARE.
SPARE = 9


def block_count(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(estimated_bytes(df) / BLOCK_BYTES))


def in_blocks(df: DataFrame, key: str, count: int, text: str) -> DataFrame:
    """(block, row): df's rows in one struct column, dealt over blocks by a hash of key and text."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.col(f"`{key}`"), F.length(F.col(f"`{text}`"))).alias("h"))
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), count // PER_PARTITION)
    return packed.select(F.pmod(F.col("h"), F.lit(count)).cast("int").alias("block"), "row").repartition(partitions, "block")


def fingerprint_bits(features: float) -> int:
    """Multiple of 8, so that byte planes are whole."""
    return min(64, 8 * math.ceil((math.log2(max(features, 2)) + SPARE) / 8))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as planes of the bytes of their differences."""
    if not len(values):
        return b""
    delta = np.diff(values, prepend=np.uint64(0))
    planes = delta.astype("<u8").view(np.uint8).reshape(-1, 8).T
    wide = int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1
    return bytes([wide]) + planes[:wide].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    wide = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(wide, -1)
    delta = np.zeros((planes.shape[1], 8), np.uint8)
    delta[:, :wide] = planes.T
    return np.cumsum(delta.reshape(-1).view("<u8"), dtype=np.uint64)


def buckets_of(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Edges of each bucket in sorted fingerprints of `bits` bits: equal ranges of the hash space."""
    limits = [min((i << bits) // buckets, (1 << 64) - 1) for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(values, np.array(limits, dtype=np.uint64)), [len(values)]])


def fingerprints(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def count_across_blocks(blocks: DataFrame, features: Callable[[pa.Array], np.ndarray], bits: int, buckets: int, levels: int = 1) -> DataFrame:
    """(block, bucket, flags) for blocks from in_blocks().

    features gives the 64-bit hashes of the rows of one block, in any order, repeated ones too. flags has one byte for each distinct
    fingerprint of the block in its bucket, in order: in how many blocks it occurs, as min(levels, log2 of that
    number, rounded up); so it is 0 for a fingerprint of one block only.
    """
    def ship(batches):
        memory_for("blocks")
        for block, rows in by_block(batches):
            found = sorted_unique(fingerprints(features(rows), bits))
            edges = buckets_of(found, bits, buckets)
            full = np.flatnonzero(np.diff(edges))
            for at in range(0, len(full), 256):
                some = full[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([pack_sorted(found[edges[k] : edges[k + 1]]) for k in some], pa.binary())],
                    names=["block", "bucket", "packed"],
                )

    def count(batches):
        memory_for("blocks")
        for (bucket,), table in by_run(batches, "bucket"):
            parts = [unpack_sorted(x) for x in table.column("packed").to_pylist()]
            sizes = np.array([len(p) for p in parts])
            every, inverse = distinct_ranks(np.concatenate(parts))
            times = np.bincount(inverse, minlength=len(every))
            level = np.minimum(np.ceil(np.log2(times)), levels).astype(np.uint8)[inverse]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            flags = [level[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([table.column("block").combine_chunks(), pa.array([bucket] * len(parts), pa.int32()), pa.array(flags, pa.binary())], names=["block", "bucket", "flags"])

    shipped = blocks.mapInArrow(ship, "block int, bucket int, packed binary")
    dealt = shipped.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "block int, bucket int, flags binary")


def by_block(batches):
    """(block, rows as one struct array) for each block of a partition whose batches come in any order of blocks.

    A partition holds the few blocks that hash to it, each of a bounded size.
    """
    held: dict[int, list] = {}
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for block in np.unique(blocks):
            held.setdefault(int(block), []).append(batch.column(1) if (blocks == block).all() else batch.column(1).filter(pa.array(blocks == block)))
    for block in list(held):
        parts = held.pop(block)
        yield block, pa.concat_arrays(parts)
        del parts
        trim()


def by_run(batches, *names: str):
    """(key values, table) for each run of equal integer keys in sorted batches."""
    held, now = [], None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(edges, edges[1:]):
            key = tuple(keys[:, a].tolist())
            if now is not None and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
    trim()


def flags_of_block(replies: pa.Table) -> np.ndarray:
    """All flags of a block in the order of its distinct fingerprints."""
    order = np.argsort(replies.column("bucket").to_numpy(zero_copy_only=False), kind="stable")
    flags = replies.column("flags").to_pylist()
    return np.frombuffer(b"".join(flags[i] for i in order), dtype=np.uint8)
