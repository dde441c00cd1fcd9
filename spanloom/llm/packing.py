"""Sequence packing as vector bin packing.

Every example has a demand vector: tokens, segments (pieces of a sequence) and loss-bearing tokens. Sequences
have a capacity for each. Sequences are filled one after the other: the next example is the one whose demand has
the largest dot product with the capacity that is left, both as shares of the whole capacity, among those that
fit in every dimension. When none fits and cutting is allowed, the example with the largest dot product is cut
to the tokens and loss-bearing tokens that are left, and its rest goes back to the waiting examples.

Packing is local to a partition and to a bounded pool of waiting examples, so it needs no shuffle: each
partition leaves at most one sequence that is not full for want of examples. Sequence ids are
(partition << 40) + number in the partition.

Defined cases: a null text is an empty text and packs as its end token alone; repeated rows are packed each; a very
long text is cut over many sequences, and its ids wait in memory until its last piece is placed; ties go to the example
that came first; other columns stay out of the result; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACED, encoded, share, shared_replay

#: Waiting examples among which the dot-product rule chooses.
POOL = 256


class VectorPacker:
    """Fills sequences under limits on tokens, segments and loss-bearing tokens.

    add(key, tokens, loss) takes examples, where loss is the number of loss-bearing tokens at the example's end
    (the prompt stands before the answer). Pieces come out as (key, start, length, sequence, offset).
    """

    def __init__(self, tokens: int = 1024, segments: int = 256, loss: int | None = None, cut: bool = True, pool: int = POOL):
        self.limit = np.array([tokens, segments, loss or tokens], dtype=float)
        self.cut, self.size = cut, pool
        self.keys: list = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.free: list[int] = []  # tokens without loss at the example's start
        self.sequence = 0
        self.used = np.zeros(3)

    def add(self, key, tokens: int, loss: int) -> Iterator[tuple]:
        if not self.cut and (tokens > self.limit[0] or loss > self.limit[2]):
            raise ValueError(f"an example of {tokens} tokens, {loss} of them with loss, fits no sequence")
        self.keys.append(key)
        self.begin.append(0)
        self.end.append(tokens)
        self.free.append(tokens - loss)
        if len(self.keys) >= self.size:
            yield from self._fill(self.size // 2)

    def finish(self) -> Iterator[tuple]:
        yield from self._fill(0)
        if self.used[0]:
            self._close()

    def _close(self) -> None:
        self.sequence += 1
        self.used[:] = 0

    def _fill(self, leave: int) -> Iterator[tuple]:
        begin, end, free = np.array(self.begin), np.array(self.end), np.array(self.free)
        alive = np.ones(len(begin), dtype=bool)
        share = 1 / self.limit
        left_over = len(begin)
        while left_over > leave:
            room = self.limit - self.used
            if room[0] < 1 or room[1] < 1 or room[2] < 1:
                self._close()
                continue
            need = end - begin
            loss = end - np.maximum(begin, free)
            score = need * (room[0] * share[0] ** 2) + room[1] * share[1] ** 2 + loss * (room[2] * share[2] ** 2)
            fits = alive & (need <= room[0]) & (loss <= room[2])
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1)))
                take = int(need[at])
            elif self.cut:
                at = int(np.argmax(np.where(alive, score, -1)))
                clear = max(0, int(free[at] - begin[at]))  # tokens without loss come first
                take = int(min(need[at], room[0], clear + room[2]))
            else:
                self._close()
                continue
            lossy = max(0, int(begin[at]) + take - max(int(begin[at]), int(free[at])))
            yield self.keys[at], int(begin[at]), take, self.sequence, int(self.used[0])
            self.used += (take, 1, lossy)
            begin[at] += take
            if begin[at] >= end[at]:
                alive[at] = False
                left_over -= 1
        rest = np.flatnonzero(alive)
        self.keys = [self.keys[i] for i in rest]
        self.begin, self.end, self.free = ([int(x) for x in a[rest]] for a in (begin, end, free))


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", tokens: int = 1024, segments: int = 256, loss: int | None = None, lean: bool = False) -> DataFrame:
    """Whole texts, each ended by end_id, cut and packed into sequences: one row for each piece.

    All tokens of a document bear loss. tokens, segments and loss are the limits of a sequence.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    shared = share(df, tokenizer_path)
    end = np.array([end_id], dtype="<u4")
    kept = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string"))
    schema = kept.select(key)
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    id_type = to_arrow_type(kept.schema[0].dataType)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        work, packer = shared_replay(shared, SPACED, lean), VectorPacker(tokens, segments, loss)
        waiting: dict[int, tuple] = {}
        number = 0

        def rows(pieces: Iterable[tuple]) -> list[tuple]:
            out = []
            for n, start, length, sequence, offset in pieces:
                doc, ids = waiting[n]
                out.append((doc, start, length, zlib.crc32(ids[start : start + length]), len(ids), base + sequence, offset))
                if start + length == len(ids):
                    del waiting[n]
            return out

        def batch_of(made: list[tuple]):
            cols = list(zip(*made)) if made else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, b, ids, edges in encoded(work, batch.column(1)):
                made: list[tuple] = []
                at = edges.tolist()
                for doc, x, y in zip(docs[a:b], at, at[1:]):
                    waiting[number] = (doc, np.concatenate([ids[x:y], end]))
                    made += rows(packer.add(number, y - x + 1, y - x + 1))
                    number += 1
                if made:
                    yield batch_of(made)
        if made := rows(packer.finish()):
            yield batch_of(made)

    return kept.mapInArrow(run, schema.schema)


def pack_examples(df: DataFrame, key: str, tokens_col: str, loss_col: str, tokens: int = 1024, segments: int = 16, loss: int = 768, cut: bool = False) -> DataFrame:
    """Instruction examples by their counts alone: tokens and loss-bearing tokens, packed whole unless cut is set.

    Nulls count as 0 tokens; an example of no tokens takes no place and is left out of the result.
    """
    kept = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{tokens_col}`"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.col(f"`{loss_col}`"), F.lit(0)).cast("long").alias("loss"))
    schema = kept.select("key").schema
    for name in ("start", "length", "sequence_id", "offset"):
        schema = schema.add(name, "long")

    def run(frames: Iterator):
        import pandas as pd
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = VectorPacker(tokens, segments, loss, cut)

        def frame(pieces):
            return pd.DataFrame([(k, s, n, base + q, o) for k, s, n, q, o in pieces], columns=["key", "start", "length", "sequence_id", "offset"])

        for pdf in frames:
            made: list[tuple] = []
            for k, n, x in zip(pdf["key"], pdf["tokens"], pdf["loss"]):
                if n > 0:
                    made += packer.add(k, int(n), min(int(x), int(n)))
            yield frame(made)
        yield frame(packer.finish())

    return kept.mapInPandas(run, schema)


def packed(docs: DataFrame, lean: bool = False) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), lean=lean)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 8: all documents into sequences of at most 1024 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

