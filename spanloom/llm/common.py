"""Helpers shared by the corpus operators: checkpoints, sizes, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import uuid
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents without an id sort after every other document and are never a source for others.
NO_ID = (1 << 63) - 1

MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; one is set only where none is configured (tests, notebooks)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"spanloom-checkpoints-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(root)
        return root
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Catalyst's estimates from here on stand for an unknown size.
UNKNOWN_BYTES = 1 << 60


_MEMOS: dict[str, dict] = {}


def trim() -> None:
    """Hand freed memory back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def memory_for(operator: str) -> dict:
    """The memos of one operator in this Python worker; those of others are dropped.

    Workers outlive tasks and stages, so what an operator remembers would stay beside what the next one needs. For the
    same reason Arrow's buffers come from the system's allocator here, which gives them back.
    """
    import pyarrow as pa

    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    others = [k for k in _MEMOS if k != operator]
    for k in others:
        _MEMOS.pop(k).clear()
    if others:
        gc.collect()
        trim()
    return _MEMOS.setdefault(operator, {})


def unused(name: str, columns: list[str]) -> str:
    """A column name like the given one that a table doesn't have."""
    while name in columns:
        name += "_"
    return name


def estimated_bytes(df: DataFrame) -> int:
    """Size of what a plan reads: Catalyst's estimate for its leaves (file sizes for scans), whatever columns it takes.

    Where a leaf's size is unknown (local rows, a cache that is not filled), the bytes of df's texts are summed instead.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(float(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size < UNKNOWN_BYTES:
        return int(size)
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
    total = df.agg(F.coalesce(F.sum(sum(texts, F.lit(16).cast("long"))), F.lit(0))).first()[0]
    return int(total)


def parts(df: DataFrame, bytes_each: int, least: int | None = None) -> int:
    """Partitions so that each holds about bytes_each of df; never fewer than the session's shuffle partitions."""
    spark = df.sparkSession
    floor = least if least is not None else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(floor, math.ceil(estimated_bytes(df) / bytes_each))


def utf8(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# ---------------------------------------------------------------------------------------------------
# Vectorised hashing of words and windows over one Arrow string column


def _fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Words up to so many bytes are hashed by lanes of eight; longer ones, which are few, by a keyed digest of their bytes.
LANES = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
#: Masks of the first 0 to 8 bytes of a lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array without nulls counted (a null is an empty text)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of every word of every row, and the row's first word index (length rows + 1).

    A word is a maximal run of bytes other than space and U+0009..U+000D inside one row.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    rows = offsets[:-1]
    rows = rows[rows < n]
    begin[rows] = solid[rows]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    end[last] = solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw on, as integers; zeros follow its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word; lower makes A-Z equal to a-z.

    Lane after lane goes through a finaliser that is one-to-one, so different words of up to eight bytes and of one
    length never collide. Words beyond LANES lanes get a keyed BLAKE2b digest.
    """
    if lower:
        raw = _LOWER[raw]
    sizes = ends - starts
    eight = lanes(raw)
    with np.errstate(over="ignore"):
        out = _fmix(sizes.astype(np.uint64) * np.uint64(_MULT) + np.uint64(seed & MASK) * np.uint64(0xC2B2AE3D27D4EB4F))
        at, size = slice(None), sizes
        for k in range(LANES):
            out[at] = _fmix(out[at] ^ (eight[starts[at] + 8 * k] & _FIRST[np.minimum(size, 8)]))
            at = np.flatnonzero(sizes > 8 * (k + 1))
            if not len(at):
                return out
            size = sizes[at] - 8 * (k + 1)
    key = seed.to_bytes(8, "little")
    for i in at.tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return out


def equal_spans(raw: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from each start on equal those from the other start on, over the given sizes: compared in full."""
    out = np.ones(len(starts), dtype=bool)
    eight = lanes(raw)
    at, k = np.flatnonzero(starts != others), 0
    while len(at) and k < LANES:
        mask = _FIRST[np.minimum(sizes[at] - 8 * k, 8)]
        out[at] &= ((eight[starts[at] + 8 * k] ^ eight[others[at] + 8 * k]) & mask) == 0
        k += 1
        at = at[sizes[at] > 8 * k]
    for i in at.tolist():
        out[i] = out[i] and np.array_equal(raw[starts[i] : starts[i] + sizes[i]], raw[others[i] : others[i] + sizes[i]])
    return out


def sorted_unique(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by one sort: many times faster on hashes than a table of them."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def distinct_ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def hash_order(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An order by low, then high. Rows of one low hash have one high hash, but for collisions, so low alone mostly tells."""
    order = np.argsort(low)
    tied = np.flatnonzero(low[order[1:]] == low[order[:-1]])
    return np.lexsort((high, low)) if (high[order[tied]] != high[order[tied + 1]]).any() else order


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words, at the index of its first word (length len(words) - size + 1)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        out = words[:n] * weights[0]
        for k in range(1, size):
            out += words[k : k + n] * weights[k]
        return _fmix(out)
