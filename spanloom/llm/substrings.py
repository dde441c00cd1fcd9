"""Substring dedup over the de Bruijn graph of words.

An edge of the graph is a run of `size` words (a window). An edge repeats if its words also stand in a document with
a smaller id, and its source is the smallest such id. Only repeated edges matter; they are found and compacted by
joins of packed blocks of documents, never with a row for each window:

1. Filter. Every block ships short fingerprints of its distinct edges; buckets of the fingerprint space answer
   which of them occur in two blocks at least (blocks.count_across_blocks). The answer is joined with the block.
2. Edges. A block resolves the repeats inside itself, then ships the 128-bit hashes of its edges that passed the
   filter, with the source coordinates of each: the smallest document that holds it and the first place there. Buckets
   of the hash space answer with the source coordinates over all blocks. Edges go out and come back in the order of
   their coordinates.
3. Compaction. The answers are joined with the block; in each document, consecutive repeated edges whose sources stand
   one behind the other in one document form one nonbranching path, and paths compact into spans of words with their
   source and the place there, where the whole span stands. The words of the spans are removed.

Identity is that of 128-bit hashes of the words. Windows are judged on the input, not on what is left.

Skew: an edge that is in a third of all documents costs one entry for each block. Blocks are bounded by bytes of
input; a document longer than a block is a block of its own size. Shuffled are the documents once, and a few bytes
for each window.

Defined cases: a null or empty text has no words and stays as it is; documents with a null id come after all
others and are nobody's source; documents with equal ids don't count as each other's source; other columns stay;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_count, by_run, count_across_blocks, fingerprint_bits, fingerprints, flags_of_block, in_blocks
from .common import NO_ID, column_bytes, estimated_bytes, hash_order, hash_words, window_hashes, word_spans

SIZE = 13
SEEDS = (101, 202)
#: Windows of one bucket of the filter, about; an input byte of a compressed table holds less than half a word.
BUCKET = 2_000_000
WORDS_PER_BYTE = 0.3


class Block:
    """The windows of the rows of one block, in row order."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, size: int, wide: bool):
        raw, offsets = column_bytes(texts)
        starts, ends, self.first = word_spans(raw, offsets)
        words = hash_words(raw, starts, ends, SEEDS[0])
        row_of = np.searchsorted(self.first, np.arange(len(words)), side="right") - 1
        self.low = window_hashes(words, size, SEEDS[0])
        n = len(self.low)
        self.fits = row_of[:n] == row_of[size - 1 : size - 1 + n]
        self.at = np.flatnonzero(self.fits)  # first word of each window
        self.row = row_of[self.at]
        self.low = self.low[self.at]
        self.high = window_hashes(hash_words(raw, starts, ends, SEEDS[1]), size, SEEDS[1])[self.at] if wide else None
        self.ids = ids

    def sources(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The group of equal windows that each window is in, and of each group the smallest document with the first
        place in it, and the hashes.

        Groups are in the order of their hashes, whatever the order of the rows.
        """
        order = hash_order(self.low, self.high)
        low, high = self.low[order], self.high[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        every, rank = np.unique(self.ids, return_inverse=True)
        place = rank[self.row] << 32 | (self.at - self.first[self.row])
        smallest = np.minimum.reduceat(place[order], begin) if len(begin) else np.zeros(0, np.int64)
        return group, every[smallest >> 32], smallest & 0xFFFFFFFF, low[begin], high[begin]


def _ids(rows: pa.Array, key: str) -> np.ndarray:
    return rows.field(key).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _candidates(block: Block, flags: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Groups that another block may hold too, by bucket, smallest document and place: rows can come in any order.

    Returns the group of each window; the smallest document, the place in it and the hashes of each group; and the groups
    chosen.
    """
    group, smallest, place, low, high = block.sources()
    marks = fingerprints(low, bits)
    distinct = np.ones(len(marks), dtype=bool)
    distinct[1:] = marks[1:] != marks[:-1]
    chosen = np.flatnonzero(flags[np.cumsum(distinct) - 1] > 0)
    order = np.lexsort((place[chosen], smallest[chosen], _bucket(low[chosen], buckets)))
    return group, smallest, place, low, high, chosen[order]


def _planes(values: np.ndarray, kind: str = "<i8") -> bytes:
    """Differences of integers as planes of their bytes."""
    return np.diff(values, prepend=0).astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str = "<i8") -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind).astype(np.int64)) if raw else np.zeros(0, np.int64)


def _bucket(low: np.ndarray, buckets: int) -> np.ndarray:
    return ((low >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE):
    """(blocks, answers, bits, buckets): the parts of the plan that remove_repeats() joins; see the module's text."""
    count = block_count(df)
    windows = max(1.0, estimated_bytes(df) * WORDS_PER_BYTE)
    bits = fingerprint_bits(windows)
    buckets = max(count // 2, math.ceil(windows / BUCKET), 1)
    blocks = in_blocks(df, key, count, text)
    edges_per_bucket = buckets

    def low_hashes(rows: pa.StructArray) -> np.ndarray:
        return Block(_ids(rows, key), rows.field(text), size, False).low

    flags = count_across_blocks(blocks, low_hashes, bits, buckets)

    def ship(keys, left, right):
        rows, flags_ = left.column("row").combine_chunks(), flags_of_block(right)
        if not len(rows) or not len(flags_):
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "docs": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})
        block = Block(_ids(rows, key), rows.field(text), size, True)
        _, smallest, place, low, high, which = _candidates(block, flags_, bits, edges_per_bucket)
        to = _bucket(low[which], edges_per_bucket)
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
        parts = [which[a:b] for a, b in zip(cuts, cuts[1:])]
        return pa.table(
            {
                "block": pa.array([keys[0].as_py()] * len(parts), pa.int32()),
                "bucket": pa.array([int(to[a]) for a in cuts[:-1]], pa.int32()),
                "hashes": pa.array([np.stack([low[p], high[p]]).tobytes() for p in parts], pa.binary()),
                "docs": pa.array([_planes(smallest[p]) for p in parts], pa.binary()),
                "places": pa.array([_planes(place[p], "<i4") for p in parts], pa.binary()),
            }
        )

    def answer(batches):
        for (bucket,), table in by_run(batches, "bucket"):
            hashes = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table.column("hashes").to_pylist()]
            docs = [_unplanes(x) for x in table.column("docs").to_pylist()]
            places = [_unplanes(x, "<i4") for x in table.column("places").to_pylist()]
            sizes = [len(d) for d in docs]
            both, every, place = np.concatenate(hashes, axis=1), np.concatenate(docs), np.concatenate(places)
            order = hash_order(both[0], both[1])
            low, high = both[0][order], both[1][order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            begin, member = np.flatnonzero(new), np.cumsum(new) - 1
            least = np.minimum.reduceat(every[order], begin)
            first = np.minimum.reduceat(np.where(every[order] == least[member], place[order], 1 << 32), begin)
            source, at = np.empty((2, len(order)), dtype=np.int64)
            source[order], at[order] = least[member], first[member]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            spans_ = list(zip(edges, edges[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("block").combine_chunks(),
                    pa.array([bucket] * len(sizes), pa.int32()),
                    pa.array([_planes(source[a:b]) for a, b in spans_], pa.binary()),
                    pa.array([_planes(at[a:b], "<i4") for a, b in spans_], pa.binary()),
                ],
                names=["block", "bucket", "sources", "places"],
            )

    shipped = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(ship, "block int, bucket int, hashes binary, docs binary, places binary")
    answers = shipped.repartition(edges_per_bucket, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "block int, bucket int, sources binary, places binary")
    # Flags and answers of a block come together, so that the block's candidates can be told again.
    nothing = F.lit(None).cast("binary")
    replies = flags.withColumns({"sources": nothing, "places": nothing}).unionByName(answers.withColumn("flags", F.lit(None).cast("binary")))
    return blocks, replies, bits, edges_per_bucket


def compact(rows: np.ndarray, at: np.ndarray, source: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Spans (row, first word, words, source, first word there) of the paths of repeated windows in position order.

    Windows of a row that follow one another, and whose places in one source follow one another too, are one path: so
    the whole span stands in the source as it is.
    """
    if not len(rows):
        return np.zeros((0, 5), np.int64)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(rows))) + size - 1
    return np.stack([rows[begin], at[begin], length, source[begin], place[begin]], axis=1)


def _spans(keys, rows: pa.StructArray, replies: pa.Table, key: str, text: str, size: int, bits: int, buckets: int) -> tuple[Block, np.ndarray]:
    """The block and its spans; positions count the words of the whole block."""
    ids = _ids(rows, key)
    has_flags = replies.filter(replies.column("flags").is_valid())
    flags = flags_of_block(has_flags) if len(has_flags) else np.zeros(0, np.uint8)
    block = Block(ids, rows.field(text), size, True)
    if not len(block.at):
        return block, np.zeros((0, 5), np.int64)
    group, source, place, _, _, which = _candidates(block, flags, bits, buckets)
    answered = replies.filter(replies.column("sources").is_valid())
    by = np.argsort(answered.column("bucket").to_numpy(zero_copy_only=False), kind="stable")
    told = [answered.column(c).to_pylist() for c in ("sources", "places")]
    found, at = (np.concatenate([_unplanes(x[i], kind) for i in by]) if len(by) else np.zeros(0, np.int64) for x, kind in zip(told, ("<i8", "<i4")))
    if len(found) != len(which):
        raise ValueError(f"block {keys[0].as_py()}: {len(which)} edges asked for, {len(found)} answered")
    source[which], place[which] = found, at
    mine, there = source[group], place[group]
    repeated = mine < ids[block.row]
    return block, compact(block.row[repeated], block.at[repeated], mine[repeated], there[repeated], size)


def _removed(block: Block, spans: np.ndarray) -> np.ndarray:
    """For each word of the block whether a span covers it."""
    n = int(block.first[-1]) if len(block.first) else 0
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, spans[:, 1], 1)
    np.add.at(change, spans[:, 1] + spans[:, 2], -1)
    return np.cumsum(change[:n]) > 0


def _kept_texts(block: Block, removed: np.ndarray, texts: list) -> list[bytes]:
    """The words that stay, joined by single spaces."""
    out = []
    first = block.first.tolist()
    hit = np.add.reduceat(np.append(removed, False), block.first[:-1]) if len(removed) else np.zeros(len(texts), int)
    for i, t in enumerate(texts):
        a, b = first[i], first[i + 1]
        words = (t or "").encode().split()
        out.append(b" ".join(words if a == b or not hit[i] else compress(words, (~removed[a:b]).tolist())))
    return out


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """df with the texts without their repeated spans: kept words joined by single spaces.

    Texts that lose no word stay byte for byte.
    """
    blocks, replies, bits, buckets = repeated_spans(df, key, text, size)
    schema = blocks.select("row").schema

    def finish(keys, left, right):
        rows = left.column("row").combine_chunks()
        if not len(rows):
            return pa.table({"row": rows})
        block, spans = _spans(keys, rows, right, key, text, size, bits, buckets)
        removed = _removed(block, spans)
        texts = rows.field(text).to_pylist()
        kept = _kept_texts(block, removed, texts)
        touched = np.zeros(len(texts), dtype=bool)
        touched[np.unique(spans[:, 0])] = True
        new = pa.array([k.decode() if hit else t for k, t, hit in zip(kept, texts, touched)], rows.type.field(text).type)
        fields = [new if f.name == text else rows.field(f.name) for f in rows.type]
        return pa.table({"row": pa.StructArray.from_arrays(fields, fields=list(rows.type))})

    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The repeated spans: key, first word, words, source (a document with a smaller id) and the first word there: the
    source holds the span's words from that place on."""
    narrow = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks, replies, bits, buckets = repeated_spans(narrow, "doc", "text", size)

    def finish(keys, left, right):
        rows = left.column("row").combine_chunks()
        block, found = _spans(keys, rows, right, "doc", "text", size, bits, buckets) if len(rows) else (None, np.zeros((0, 5), np.int64))
        base = block.first[found[:, 0]] if block else 0
        ids = rows.field("doc")
        return pa.table({key: ids.take(pa.array(found[:, 0])), "first": pa.array(found[:, 1] - base), "words": pa.array(found[:, 2]), "source": pa.array(found[:, 3]), "source_first": pa.array(found[:, 4])})

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, f"`{key}` long, first long, words long, source long, source_first long")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """For each row: words, removed words, and the digest of the kept words joined by single spaces."""
    narrow = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks, replies, bits, buckets = repeated_spans(narrow, "doc", "text", size)

    def finish(keys, left, right):
        rows = left.column("row").combine_chunks()
        if not len(rows):
            return pa.table({key: pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        block, found = _spans(keys, rows, right, "doc", "text", size, bits, buckets)
        removed = _removed(block, found)
        total = np.concatenate([[0], np.cumsum(removed)])
        kept = _kept_texts(block, removed, rows.field("text").to_pylist())
        return pa.table(
            {
                key: rows.field("doc"),
                "n_words": pa.array(np.diff(block.first)),
                "n_removed": pa.array(total[block.first[1:]] - total[block.first[:-1]]),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, f"`{key}` long, n_words long, n_removed long, kept_sha256 string")


def op2_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 2: every document without the words of 13-word windows that an earlier document holds."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
