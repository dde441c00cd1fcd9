"""N-gram Jaccard join with signature trees.

Two documents link when the Jaccard similarity of their sets of word 5-grams is 0.75 or more; the join is exact.

1. Documents are dealt into blocks; equal sets are one class, whose representative is its smallest document. Only
   representatives go on, so copies cost nothing beyond this.
2. Shingles are ordered by the number of blocks that hold them (blocks.count_across_blocks) and by hash. Two linked
   sets share one of the first n - ceil(0.75 n) + 1 shingles in this order, so a representative whose first
   shingles stand nowhere else links with nothing; that is most of them. Frequent shingles come last.
3. Representatives that share such a shingle fall into one candidate cluster (components of a star around the
   smallest one that holds the shingle). Each set is shipped once, to the task of its cluster.
4. In a cluster, a signature tree is built: leaves are sets, with a bitmap that has one bit for each shingle's hash;
   inner nodes hold the bitmaps of their children combined by OR, the range of their sizes and the largest number
   of shingles that share bits. The tree is traversed against itself; a pair of nodes is pruned when the largest
   possible overlap, given the bits and sizes, is below what the smallest sizes need. Pairs of leaves that remain
   are compared exactly, unless they are in one component already. Nodes all of whose sets are in one component are
   pruned too, and pairs are taken in pieces, so that memory doesn't grow with the pairs of a cluster.
5. A cluster of more than CAP sets or CAP_SHINGLES shingles is dealt into chunks, which step 4 turns into components;
   one set of each is compared across chunks, and what is still apart is compared with every chunk, by the trees of
   both sides.

Nothing emits all pairs of a group: links inside a component are not needed for the result.

Defined cases: a null text or one without words has an empty set and links with nothing; with fewer than five words
the whole sequence is the only shingle; a document with a null id links with nothing; repeated rows are copies; other columns
stay out of the result; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_count, by_block, by_run, count_across_blocks, fingerprint_bits, fingerprints, flags_of_block, in_blocks
from .common import NO_ID, column_bytes, distinct_ranks, estimated_bytes, hash_words, memory_for, save, trim, window_hashes, word_spans
from .components import components

N = 5
PERCENT = 75
SEED = 77
#: Sets and shingles of one chunk of a cluster, about, and pairs of nodes that are looked at together.
CAP = 512
CAP_SHINGLES = 1_000_000
PIECE = 4096
BITS = 1024
BUCKET = 2_000_000
WORDS_PER_BYTE = 0.3
LEVELS = 24


class Sets:
    """The shingle sets of the rows of one block: distinct hashes by row, ascending."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, n: int = N):
        raw, offsets = column_bytes(texts)
        starts, ends, first = word_spans(raw, offsets)
        words = hash_words(raw, starts, ends, SEED, lower=True)
        rows = len(ids)
        counts = np.diff(first)
        row_of = np.repeat(np.arange(rows), counts)
        hashes = window_hashes(words, n, SEED)
        k = len(hashes)
        fits = row_of[:k] == row_of[n - 1 : n - 1 + k]
        parts, owners = [hashes[fits]], [row_of[:k][fits]]
        for m in range(1, n):  # rows of m words: the whole sequence
            short = np.flatnonzero(counts == m)
            if len(short):
                at = first[short]
                parts.append(window_hashes(words[(at[:, None] + np.arange(m)).reshape(-1)], m, SEED + m)[::m])
                owners.append(short)
        hashes, owner = np.concatenate(parts), np.concatenate(owners)
        # By row, then by the leading bits of the hash: one sort of integers.
        width = max(1, int(rows).bit_length())
        order = np.argsort(owner.astype(np.uint64) << np.uint64(64 - width) | hashes >> np.uint64(width))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=rows)
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = ids

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over each set, of differently scrambled hashes; equal sets, equal sums."""
        with np.errstate(over="ignore"):
            out = []
            for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                mixed = self.hashes * np.uint64(mult)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
                out.append((sums[self.edges[1:]] - sums[self.edges[:-1]] + self.sizes.astype(np.uint64)).view(np.int64))
        return out[0], out[1]

    def firsts(self) -> np.ndarray:
        """For each row the smallest id of the block's rows with the same set; its own for an empty set."""
        low, high = self.digests()
        order = np.lexsort((self.ids, high, low))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        out = np.empty(len(order), dtype=np.int64)
        out[order] = self.ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else 0
        return np.where(self.sizes == 0, self.ids, out)


def _sets(rows: pa.StructArray, n: int) -> Sets:
    ids = rows.field("doc").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    return Sets(ids, rows.field("text"), n)


def _chosen(sets: Sets, first: np.ndarray) -> np.ndarray:
    """One row for each distinct nonempty set of the block: a row whose id is the smallest."""
    low, high = sets.digests()
    mine = np.flatnonzero((sets.ids == first) & (sets.sizes > 0))
    order = mine[np.lexsort((high[mine], low[mine], sets.ids[mine]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (sets.ids[order][1:] != sets.ids[order][:-1]) | (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    return order[new]


class UnionFind:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            while self.parent[a] != a:
                a = int(self.parent[a])
            while self.parent[b] != b:
                b = int(self.parent[b])
            if a != b:
                self.parent[max(a, b)] = min(a, b)


class SignatureTree:
    """Levels of nodes over sets, from the leaves up: bitmaps by OR, ranges of sizes, largest surplus.

    The surplus of a set is the number of its shingles beyond its bits, so an overlap is at most the number of
    common bits and the smaller surplus.
    """

    FAN = 8

    def __init__(self, sets: list[np.ndarray], percent: int, index: np.ndarray | None = None):
        self.percent = percent
        #: What a set is called outside this tree: its place in the whole list.
        self.index = np.arange(len(sets)) if index is None else index
        n = len(sets)
        sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
        lead = np.array([int(s[0]) if len(s) else 0 for s in sets], dtype=np.uint64)  # smallest hash: like sets, like values
        self.order = np.lexsort((sizes, lead))
        flat = np.concatenate([sets[i] for i in self.order]) if n else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(n), sizes[self.order])
        bits = np.zeros((n, BITS), dtype=bool)
        bits[owner, (flat >> np.uint64(20)).astype(np.int64) % BITS] = True
        maps = np.packbits(bits, axis=1).view(np.uint64)
        sizes = sizes[self.order]
        surplus = sizes - bits.sum(axis=1)
        self.levels = [(maps, sizes, sizes, surplus)]
        while len(maps) > 1:
            at = np.arange(0, len(maps), self.FAN)
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            low = np.minimum.reduceat(self.levels[-1][1], at)
            high = np.maximum.reduceat(self.levels[-1][2], at)
            surplus = np.maximum.reduceat(self.levels[-1][3], at)
            self.levels.append((maps, low, high, surplus))

    def possible(self, level: int, a: np.ndarray, other: SignatureTree, b: np.ndarray) -> np.ndarray:
        """Whether nodes a of this tree and b of the other, both of a level, may hold linked sets."""
        ma, la, ha, sa = self.levels[level]
        mb, lb, hb, sb = other.levels[level]
        out = (100 * ha[a] >= self.percent * lb[b]) & (100 * hb[b] >= self.percent * la[a])
        at = np.flatnonzero(out)
        common = np.zeros(len(at), dtype=np.int64)
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            common[k : k + 100_000] = np.bitwise_count(ma[a[some]] & mb[b[some]]).sum(axis=1)
        most = common + np.minimum(sa[a[at]], sb[b[at]])
        # J >= p/100 needs an overlap of at least p / (100 + p) of the sum of both sizes.
        out[at] = (100 + self.percent) * most >= self.percent * (la[a[at]] + lb[b[at]])
        return out

    def pieces(self, other: SignatureTree | None = None, found: UnionFind | None = None) -> Iterator[np.ndarray]:
        """Pairs of sets that may link, by dual traversal from the roots, depth first and PIECE pairs of nodes at once.

        Pairs of nodes all of whose sets are in one component of `found` by then are left out.
        """
        same = other is None
        other = other or self
        top = max(len(self.levels), len(other.levels)) - 1
        for tree in (self, other):
            while len(tree.levels) <= top:
                tree.levels.append(tree.levels[-1])  # a root above a root
        roots, others = np.arange(len(self.levels[top][0])), np.arange(len(other.levels[top][0]))
        stack = [(top, np.repeat(roots, len(others)), np.tile(others, len(roots)))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PIECE:
                stack += [(level, a[PIECE:], b[PIECE:]), (level, a[:PIECE], b[:PIECE])]
                continue
            if found is not None and len(a):
                label = found.labels()
                (low, high), (low_b, high_b) = self._labels(level, label), other._labels(level, label)
                apart = (low[a] != high[a]) | (low_b[b] != high_b[b]) | (low[a] != low_b[b])
                a, b = a[apart], b[apart]
            ok = self.possible(level, a, other, b)
            a, b = a[ok], b[ok]
            if level:
                if len(a):
                    stack.append((level - 1, *self._down(level, a, other, b, same)))
                continue
            if same:
                keep = a < b
                a, b = a[keep], b[keep]
            if len(a):
                yield np.stack([self.index[self.order[a]], other.index[other.order[b]]], axis=1)

    def _labels(self, level: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label below each node of a level."""
        low = high = label[self.index[self.order]]
        for k in range(1, level + 1):
            if len(self.levels[k][0]) < len(low):
                at = np.arange(0, len(low), self.FAN)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        return low, high

    def _children(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of a level."""
        if len(self.levels[level][0]) == len(self.levels[level - 1][0]):
            return at, np.ones(len(at), dtype=np.int64)
        first = at * self.FAN
        return first, np.minimum(self.FAN, len(self.levels[level - 1][0]) - first)

    def _down(self, level: int, a: np.ndarray, other: SignatureTree, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        fa, na = self._children(level, a)
        fb, nb = other._children(level, b)
        each = na * nb
        at = np.repeat(np.arange(len(a)), each)
        k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        x, y = fa[at] + k // nb[at], fb[at] + k % nb[at]
        if same:
            keep = x <= y
            x, y = x[keep], y[keep]
        return x, y


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def join_sets(sets: list[np.ndarray], percent: int, pieces: Iterable[np.ndarray] | None = None, found: UnionFind | None = None) -> UnionFind:
    """Components of sets under exact links, from the pairs that a tree leaves (or the given ones).

    Waves: each set is compared with the first partner that it is not yet joined with.
    """
    found = found or UnionFind(len(sets))
    for pairs in SignatureTree(sets, percent).pieces(None, found) if pieces is None else pieces:
        pairs = np.sort(pairs, axis=1)
        pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
        while len(pairs):
            label = found.labels()
            pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
            if not len(pairs):
                break
            first = np.ones(len(pairs), dtype=bool)
            first[1:] = pairs[1:, 1] != pairs[:-1, 1]
            now = pairs[first]
            found.join(now[[linked(sets[a], sets[b], percent) for a, b in now.tolist()]])
            pairs = pairs[~first]
    return found


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def jaccard_classes(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: key, n_shingles, class_id and component_id (smallest ids of equal and of reachable sets)."""
    count = block_count(df)
    shingles = max(1.0, estimated_bytes(df) * WORDS_PER_BYTE)
    bits, buckets = fingerprint_bits(shingles), max(count // 2, math.ceil(shingles / BUCKET), 1)
    narrow = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = in_blocks(narrow, "doc", count, "text")

    # 1. Sets, and the classes of equal ones.
    def describe(batches):
        memory_for("blocks")
        for block, rows in by_block(batches):
            sets = _sets(rows, n)
            low, high = sets.digests()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(sets.ids), pa.int32()), rows.field("doc"), pa.array(sets.sizes, pa.int64()), pa.array(low), pa.array(high), pa.array(sets.firsts())],
                names=["block", "doc", "n", "low", "high", "first"],
            )

    rows = save(blocks.mapInArrow(describe, "block int, doc long, n long, low long, high long, first long"), "sets")
    local = rows.filter("n > 0 and doc is not null").select("block", "low", "high", "first", "n").distinct()
    classes = local.groupBy("low", "high").agg(F.min("first").alias("class"), F.min(F.struct("first", "block")).alias("home"), F.min("n").alias("n"))
    classes = save(classes.select("low", "high", "class", F.col("home.block").alias("block"), "n"), "classes")

    # 2. Shingles by frequency; what representatives share among their first ones.
    flags = count_across_blocks(blocks, lambda r: _sets(r, n).hashes, bits, buckets, LEVELS)
    chosen = classes.select("block", F.struct("low", "high").alias("set")).groupBy("block").agg(F.collect_list("set").alias("sets"))
    replies = flags.select("block", "bucket", "flags", F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("sets"))
    replies = replies.unionByName(chosen.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("flags"), "sets"))
    empty = {"kind": pa.array([], pa.int32()), "token": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "other": pa.array([], pa.int64())}

    def first_shingles(keys, left, right):
        memory_for("blocks")
        arr = left.column("row").combine_chunks()
        mine = right.filter(right.column("sets").is_valid())
        if not len(arr) or not len(mine):
            return pa.table(empty)
        sets = _sets(arr, n)
        low, high = sets.digests()
        own = {(s["low"], s["high"]) for s in mine.column("sets").to_pylist()[0]}
        reps = np.array([r for r in _chosen(sets, sets.firsts()) if (int(low[r]), int(high[r])) in own], dtype=np.int64)
        level_of = flags_of_block(right.filter(right.column("flags").is_valid()))
        marks = fingerprints(sets.hashes, bits)
        level = level_of[distinct_ranks(marks)[1]]
        keep = np.zeros(len(sets.ids), dtype=bool)
        keep[reps] = True
        at = np.flatnonzero(keep[sets.owner])
        hashes, owner, level = sets.hashes[at], sets.owner[at], level[at]
        order = np.lexsort((hashes, level, owner))
        hashes, owner, level = hashes[order], owner[order], level[order]
        sizes = sets.sizes
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        need = -(-percent * sizes // 100)
        leading = rank < (sizes - need + 1)[owner]
        hashes, owner, level = hashes[leading], owner[leading], level[leading]
        order = np.lexsort((sets.ids[owner], hashes))
        hashes, ids, level = hashes[order], sets.ids[owner[order]], level[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        smallest = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(ids) else ids
        inner = np.unique(np.stack([ids[~new], smallest[~new]], axis=1), axis=0)  # shared inside the block
        outer = new & (level > 0)
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.zeros(len(inner), np.int32), np.ones(int(outer.sum()), np.int32)]), pa.int32()),
                "token": pa.array(np.concatenate([np.zeros(len(inner), np.int64), hashes[outer].view(np.int64)])),
                "rep": pa.array(np.concatenate([inner[:, 0], ids[outer]])),
                "other": pa.array(np.concatenate([inner[:, 1], np.zeros(int(outer.sum()), np.int64)])),
            }
        )

    posted = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(first_shingles, "kind int, token long, rep long, other long")
    posted = save(posted, "postings")

    # 3. Candidate clusters.
    outer = posted.filter("kind = 1").select("token", "rep")
    smallest = outer.groupBy("token").agg(F.min("rep").alias("other"), F.count("*").alias("held")).filter("held > 1")
    across = outer.join(smallest.withColumnRenamed("token", "t"), F.col("token") == F.col("t")).select("rep", "other")
    shared = posted.filter("kind = 0").select("rep", "other").unionByName(across)
    clusters = save(components(shared, "rep", "other"), "clusters")
    homes = classes.select(F.col("class").alias("c"), "block", "low", "high", "n")
    placed = clusters.join(homes, F.col("node") == F.col("c"))
    chunks = F.ceil(F.greatest(F.count("*") / F.lit(CAP), F.sum("n") / F.lit(CAP_SHINGLES)))
    sizes = placed.groupBy(F.col("root").alias("r")).agg(chunks.alias("chunks"), F.ceil(F.count("*") / chunks).alias("each"))
    dealt = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int")
    placed = placed.join(sizes, F.col("root") == F.col("r")).select("block", F.struct("low", "high", "node", F.col("root").alias("cluster"), "chunks", "each", dealt.alias("chunk")).alias("want"))
    wanted = placed.groupBy("block").agg(F.collect_list("want").alias("wants"))

    def ship(keys, left, right):
        schema = pa.schema([("cluster", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int64()), ("each", pa.int64()), ("rep", pa.int64()), ("shingles", pa.binary())])
        memory_for("blocks")
        arr = left.column("row").combine_chunks()
        if not len(arr) or not len(right):
            return schema.empty_table()
        sets = _sets(arr, n)
        low, high = sets.digests()
        at = {(int(low[r]), int(high[r])): r for r in _chosen(sets, sets.firsts())}
        out = []
        for want in right.column("wants").to_pylist()[0]:
            r = at[want["low"], want["high"]]
            out.append((want["cluster"], want["chunk"], want["chunks"], want["each"], want["node"], sets.hashes[sets.edges[r] : sets.edges[r + 1]].tobytes()))
        cols = list(zip(*out)) if out else [[]] * 6
        del sets, at, arr
        trim()
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    shipped = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(ship, "cluster long, chunk int, chunks long, each long, rep long, shingles binary")
    shipped = save(shipped, "shipped")

    # 4. Exact components of each cluster, or of each chunk of a large one.
    def resolve(batches):
        for (cluster, _), table in by_run(batches, "cluster", "chunk"):
            reps = table.column("rep").to_numpy()
            order = np.argsort(reps, kind="stable")
            sets = _unpack(table.column("shingles"))
            label = join_sets([sets[i] for i in order], percent).labels()
            yield pa.RecordBatch.from_arrays(
                [pa.array([cluster] * len(reps), pa.int64()), *[table.column(c).combine_chunks() for c in ("chunks", "each")], pa.array(reps[order]), pa.array(reps[order][label])],
                names=["cluster", "chunks", "each", "rep", "root"],
            )

    grouped = shipped.repartition(max(1, count // 2), "cluster", "chunk").sortWithinPartitions("cluster", "chunk")
    solved = save(grouped.mapInArrow(resolve, "cluster long, chunks long, each long, rep long, root long"), "solved")
    links = solved.select(F.col("rep").alias("a"), F.col("root").alias("b"))

    # 5. Large clusters: join the components of their chunks.
    large = solved.filter("chunks > 1")
    if not large.isEmpty():
        links = links.unionByName(_across_chunks(shipped, large, percent))
    final = components(links)
    class_of = local.join(classes.select(F.col("low").alias("l"), F.col("high").alias("h"), "class"), (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))).select(F.col("first").alias("f"), F.col("low").alias("fl"), "class").distinct()
    rooted = class_of.join(final, F.col("class") == F.col("node"), "left").select("f", "fl", "class", F.coalesce("root", "class").alias("root"))
    joined = rows.join(rooted, (F.col("first") == F.col("f")) & (F.col("low") == F.col("fl")) & (F.col("n") > 0), "left")
    known = lambda c: F.when((F.col("n") == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(F.col(c))
    return joined.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), known("class").alias("class_id"), known("root").alias("component_id"))


def _across_chunks(shipped: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of different chunks of the same cluster.

    First one set of each component is compared in one task (again in chunks where there are many); components
    that are still apart are the minor ones and the largest one, and every set of a minor one meets every chunk.
    """
    sets = shipped.filter("chunks > 1").select("cluster", "chunk", "each", "rep", "shingles")
    heads = large.filter("rep = root").select("cluster", "each", "rep")
    many = heads.groupBy("cluster").agg(F.count("*").alias("heads"))
    heads = heads.join(many.withColumnRenamed("cluster", "k"), F.col("cluster") == F.col("k")).select(F.col("rep").alias("head"), F.pmod(F.xxhash64("rep", F.lit("heads")), F.ceil(F.col("heads") / F.col("each"))).cast("int").alias("part"))
    head_sets = sets.join(heads, F.col("rep") == F.col("head")).select("cluster", "part", "rep", "shingles")

    def meet(keys, table):
        memory_for("blocks")
        reps = table.column("rep").to_numpy()
        label = join_sets(_unpack(table.column("shingles")), percent).labels()
        return pa.table({"a": pa.array(reps), "b": pa.array(reps[label])})

    first = save(head_sets.groupBy("cluster", "part").applyInArrow(meet, "a long, b long"), "heads")
    links = large.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(first)
    now = components(links)
    labelled = large.select("cluster", F.col("rep").alias("r")).join(now, F.col("r") == F.col("node"), "left").select("cluster", "r", F.coalesce("root", "r").alias("root"))
    sizes = labelled.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("apart")).filter("apart > 1").select(F.col("cluster").alias("c"), F.col("top.root").alias("top"))
    open_ = save(labelled.join(largest, F.col("cluster") == F.col("c")).select("cluster", "r", "root", (F.col("root") != F.col("top")).alias("minor")), "open")
    if open_.isEmpty():
        return first
    counts = open_.groupBy("cluster").agg(F.count("*").alias("all"), F.sum(F.col("minor").cast("int")).alias("minors"))
    told = sets.join(open_.withColumnRenamed("cluster", "oc"), F.col("rep") == F.col("r")).select("cluster", "rep", "root", "minor", "each", "shingles")
    told = told.join(counts.withColumnRenamed("cluster", "k"), F.col("cluster") == F.col("k"))
    parts, minor_parts = F.ceil(F.col("all") / F.col("each")).cast("int"), F.ceil(F.col("minors") / F.col("each")).cast("int")
    mine, theirs = F.pmod(F.xxhash64("rep", F.lit("all")), parts).cast("int"), F.pmod(F.xxhash64("rep", F.lit("minor")), minor_parts).cast("int")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    every = told.select("cluster", "rep", "root", "shingles", F.lit(False).alias("minor"), mine.alias("x"), F.explode(spread(minor_parts)).alias("y"))
    minor = told.filter("minor").select("cluster", "rep", "root", "shingles", F.lit(True).alias("minor"), theirs.alias("y"), F.explode(spread(parts)).alias("x"))

    def compare(keys, table):
        memory_for("blocks")
        is_minor = table.column("minor").to_numpy(zero_copy_only=False)
        roots, reps, found = table.column("root").to_numpy(), table.column("rep").to_numpy(), _unpack(table.column("shingles"))
        a, b = np.flatnonzero(is_minor), np.flatnonzero(~is_minor)
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        trees = [SignatureTree([found[i] for i in at], percent, at) for at in (a, b)]
        start = UnionFind(len(reps))
        _, group = np.unique(roots, return_inverse=True)
        lead = np.full(group.max() + 1, len(reps))
        np.minimum.at(lead, group, np.arange(len(reps)))
        start.parent = lead[group]
        label = join_sets(found, percent, trees[0].pieces(trees[1], start), start).labels()
        return pa.table({"a": pa.array(roots), "b": pa.array(roots[label])})

    grid = every.unionByName(minor).groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long")
    return first.unionByName(grid.filter("a <> b").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id.

    Rows without words, or without an id, all stay. Of rows that repeat both id and text one stays.
    """
    classes = save(jaccard_classes(docs, key, text).filter(F.col(key).isNotNull()).select(F.col(key).alias("__id"), (F.col(key) != F.col("component_id")).alias("__go"), "n_shingles"), "verdicts")
    gone = classes.filter("__go").select("__id").distinct()
    twice = classes.filter("n_shingles > 0").groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select("__id")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{key}`").alias("__key"))
    left = packed.join(gone, F.col("__key") == F.col("__id"), "left_anti")
    if not twice.isEmpty():
        some = left.join(twice, F.col("__key") == F.col("__id"), "left_semi").withColumn("__text", F.col(f"__row.`{text}`"))
        worded = F.coalesce(F.col("__text").rlike(r"[^ \t-\r]"), F.lit(False))
        left = left.join(twice, F.col("__key") == F.col("__id"), "left_anti")
        left = left.unionByName(some.filter(worded).dropDuplicates(["__key", "__text"]).drop("__text")).unionByName(some.filter(~worded).drop("__text"))
    return left.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 3: every document with the smallest document that links lead to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "n_shingles", "component_id")
