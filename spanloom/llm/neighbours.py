"""Near-duplicate embeddings by NN-descent.

Vectors of one label and dimension are compared by cosine in double precision. Equal vectors are one class; only
classes go on, with their numbers of copies.

1. Start. Random hyperplanes deal the vectors into buckets, in several tables; each vector's best partners in its
   bucket with a cosine of FLOOR or more are the first neighbours. Buckets beyond BUCKET vectors are cut by further
   hyperplanes.
2. Descent. A vector's list holds its `width` best neighbours. Each round joins neighbours with their neighbours'
   neighbours and computes the cosines of pairs that no links join yet; what is found enters the lists, links or not.
   Rounds end when none of the pairs is a link and fewer than DELTA of the lists' entries are new.
3. Saturated lists. A list of `width` links may cut others off, which takes a group of more than `width` vectors. Such
   groups are compared with all vectors around them: a group is a ball around its root, and by the triangle inequality
   only vectors within the ball's radius and the threshold's angle can link with it; these meet the group in tiles.
   Where links are found the descent goes on, until no large group has a link to the outside.
4. Audit. Vectors drawn from groups of every size class, at most AUDIT of a class, are compared with all vectors, block
   by block. While the mean share of a vector's links that fall inside its group is below RECALL in any class, or no link
   is met at all, the start is repeated with new hyperplanes (at most TABLES_MOST tables), and the descent goes on. If that is not enough, groups
   of every size are compared as in 3, which is exact.
5. Count. The vectors of each group are compared in tiles, which count the links of each vector and emit no pairs.

Lists and edges are tables in the shared folder; nothing but the audit's sample (at most about AUDIT vectors
of a class) and counters reaches the driver.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a
label, link with nothing; vectors of different lengths don't link; a null id is a vector of its own that links with
nothing; repeated rows are copies of each other; labels that are no integers are compared by a 64-bit hash; components
other than floats are an error; extra columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import by_run
from .common import save
from .components import components

THRESHOLD = 0.98
FLOOR = 0.9
WIDTH = 16
TABLES = 16
TABLES_MOST = 256
BUCKET = 256
TILE = 1024
AUDIT = 512
RECALL = 0.995
ROWS = 20_000
DELTA = 0.01
#: Centres and vectors that meet in one tile, centres compared at once, and slack of an angle for rounding.
CENTRES, VECTORS, SLICE = 8192, 4096, 512
SLACK = 1e-6


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of x with all rows of y, in double precision."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    return (x @ y.T) / (nx[:, None] * ny[None, :])


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float32).reshape(len(values), -1).astype(np.float64)


def _clean(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, dim, vec) of the vectors that can link: vec has the components' bytes."""
    kinds = dict(df.dtypes)
    if kinds[vector] != "array<float>":
        raise ValueError(f"{vector} is {kinds[vector]}: vectors have float components")
    group = F.col(f"`{label}`").cast("long") if kinds[label] in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(f"`{label}`").isNotNull(), F.xxhash64(F.col(f"`{label}`")))
    base = df.select(F.col(f"`{key}`").cast("long").alias("id"), group.alias("label"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    sound = F.exists("v", lambda c: c != 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    base = base.filter("id is not null and label is not null and v is not null").filter(F.size("v") > 0).filter(sound)

    def pack(batches):
        for batch in batches:
            lists = batch.column(2)
            raw = (lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)).tobytes()  # -0 becomes 0
            dims = lists.value_lengths().to_numpy().astype(np.int64)
            edges = (4 * np.concatenate([[0], np.cumsum(dims)])).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims), pa.array([raw[a:b] for a, b in zip(edges, edges[1:])], pa.binary())],
                names=["id", "label", "dim", "vec"],
            )

    return base.mapInArrow(pack, "id long, label long, dim long, vec binary")


def _planes(dim: int, seed: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _by_dim(batch, column: int):
    """Row numbers and matrix for each dimension in a batch."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(batch.column(column).take(pa.array(at)))


def _bucket_pairs(ids: np.ndarray, x: np.ndarray, seed: int, floor: float, width: int):
    """Each vector's best partners in a bucket, of a cosine of floor or more; a large bucket is halved first.

    Where vectors can't be parted by hyperplanes (they nearly coincide), runs of BUCKET vectors overlap by half.
    """
    todo = [(np.arange(len(ids)), 0)]
    while todo:
        at, depth = todo.pop()
        if len(at) > BUCKET and depth < 24:
            side = x[at] @ _planes(x.shape[1], seed + 7919 * (depth + 1), 1)[:, 0]
            cut = np.median(side)
            todo += [(at[side <= cut], depth + 1), (at[side > cut], depth + 1)] if (side > cut).any() else [(at, 24)]
            continue
        for a in range(0, max(1, len(at) - BUCKET // 2), BUCKET // 2):
            part = at[a : a + BUCKET]
            cos = cosines(x[part], x[part])
            np.fill_diagonal(cos, -2)
            if len(part) > width:  # the next one in a row of ids comes too, so that groups hold together
                limit = -np.partition(-cos, width - 1, axis=1)[:, width - 1 : width]
                keep = cos >= np.maximum(limit, floor)
                keep &= np.cumsum(keep, axis=1) <= width
                keep |= (np.eye(len(part), k=1) > 0) & (cos >= floor)
            else:
                keep = cos >= floor
            i, j = np.nonzero(keep)
            yield ids[part[i]], ids[part[j]], cos[i, j]


def _edges(a, b, cos):
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(cos)], names=["a", "b", "cos"])


EDGE = "a long, b long, cos double"


def start(reps: DataFrame, largest: int, first_table: int, tables: int, count: int, floor: float, width: int) -> DataFrame:
    """Edges between vectors that share a bucket of any of the tables."""
    bits = max(0, math.ceil(math.log2(max(1, largest) / 16)))

    def deal(batches):
        for batch in batches:
            for dim, at, x in _by_dim(batch, 3):
                for t in range(first_table, first_table + tables):
                    sides = x @ _planes(dim, t, bits) > 0 if bits else np.zeros((len(at), 0), bool)
                    code = sides @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(at), pa.int64()), pa.array(code, pa.int64()), *[batch.column(c).take(pa.array(at)) for c in (1, 2, 0, 3)]],
                        names=["table", "code", "label", "dim", "id", "vec"],
                    )

    def meet(batches):
        for (table, *_), rows in by_run(batches, "label", "dim", "table", "code"):
            if len(rows) < 2:
                continue
            for found in _bucket_pairs(rows.column("id").to_numpy(), _matrix(rows.column("vec")), table, floor, width):
                if len(found[0]):
                    yield _edges(*found)

    keys = ("label", "dim", "table", "code")
    dealt = reps.mapInArrow(deal, "table long, code long, label long, dim long, id long, vec binary")
    return dealt.repartition(count, *keys).sortWithinPartitions(*keys).mapInArrow(meet, EDGE).dropDuplicates(["a", "b"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "cos").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))


def groups(reps: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(node, root): the groups that links among the edges join, single vectors included."""
    joined = components(edges.filter(F.col("cos") >= threshold))
    return save(reps.select(F.col("id").alias("n")).join(joined, F.col("n") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("root", "n").alias("root")), "groups")


def descend(reps: DataFrame, edges: DataFrame, threshold: float, floor: float, width: int) -> tuple[DataFrame, DataFrame]:
    """(edges, groups) after joining neighbours of neighbours until no new pair links two groups."""
    vectors = reps.select(F.col("id").alias("k"), "vec")
    while True:
        group = groups(reps, edges, threshold)
        best = _both_ways(edges).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cos").desc(), "b"))).filter(F.col("rank") <= width)
        lists = save(best.select("a", "b", "cos"), "lists")
        # x - m - y: m is on the list of x, y on the list of m.
        steps = lists.select(F.col("b").alias("m"), F.col("a").alias("x")).join(lists.select(F.col("a").alias("m2"), F.col("b").alias("y")), F.col("m") == F.col("m2"))
        fresh = steps.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
        of = lambda end: group.select(F.col("node").alias(f"n{end}"), F.col("root").alias(f"r{end}"))
        apart = fresh.join(of("a"), F.col("a") == F.col("na")).join(of("b"), F.col("b") == F.col("nb")).filter("ra <> rb").select("a", "b")
        apart = apart.join(edges.select("a", "b"), ["a", "b"], "left_anti")
        given = apart.join(vectors, F.col("a") == F.col("k")).select("a", "b", F.col("vec").alias("va")).join(vectors, F.col("b") == F.col("k")).select("a", "b", "va", F.col("vec").alias("vb"))

        def score(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                va, vb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                cos = np.empty(len(va))
                for dim in {len(x) for x in va}:
                    at = [i for i, x in enumerate(va) if len(x) == dim]
                    x, y = (np.frombuffer(b"".join(v[i] for i in at), np.float32).reshape(len(at), -1).astype(np.float64) for v in (va, vb))
                    cos[at] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                keep = cos >= floor
                yield _edges(batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep], cos[keep])

        new = save(given.mapInArrow(score, EDGE), "edges")
        if new.filter(F.col("cos") >= threshold).isEmpty() and new.count() <= DELTA * lists.count():
            return edges, group
        edges = save(edges.unionByName(new), "edges")


def count_links(reps: DataFrame, classes: DataFrame, group: DataFrame, threshold: float, count: int) -> DataFrame:
    """(id, others): copies of all vectors linked with each vector of a group of two and more.

    The vectors of a group are dealt into parts of about TILE, and each pair of parts is one tile.
    """
    sizes = group.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1").withColumnRenamed("root", "r")
    placed = group.join(sizes, F.col("root") == F.col("r")).join(reps, F.col("node") == F.col("id")).join(classes.select(F.col("rep").alias("w"), "copies"), F.col("id") == F.col("w"))
    n = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit("tile")), n).cast("int")
    dealt = placed.select("root", "id", "copies", "vec", part.alias("part"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    tiled = dealt.select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "id", "copies", "vec")
    tiled = tiled.repartition(count, "root", "x", "y").sortWithinPartitions("root", "x", "y")

    def tile(batches):
        for (_, x, y), rows in by_run(batches, "root", "x", "y"):
            ids, copies, part = (rows.column(c).to_numpy() for c in ("id", "copies", "part"))
            vectors = _matrix(rows.column("vec"))
            a, b = np.flatnonzero(part == x), np.flatnonzero(part == y)
            if not len(a) or not len(b):
                continue
            hit = cosines(vectors[a], vectors[b]) >= threshold
            if x == y:
                np.fill_diagonal(hit, False)
                found, others = ids[a], hit @ copies[b]
            else:
                found, others = np.concatenate([ids[a], ids[b]]), np.concatenate([hit @ copies[b], hit.T @ copies[a]])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(others.astype(np.int64))], names=["id", "others"])

    return tiled.mapInArrow(tile, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def balls(placed: DataFrame, least: int) -> DataFrame:
    """(label, dim, root, centre, radius): groups of at least `least` vectors, as balls around their roots."""
    centres = placed.filter(F.col("id") == F.col("root")).filter(F.col("size") >= least).select(F.col("root").alias("r"), F.col("vec").alias("centre"))
    inside = placed.filter(F.col("size") >= least).select("label", "dim", "root", "vec").join(centres, F.col("root") == F.col("r")).select("label", "dim", "root", "vec", "centre")

    def reach(batches):
        for batch in batches:
            far = np.zeros(batch.num_rows)
            for _, at, x in _by_dim(batch, 3):
                y = _matrix(batch.column(4).take(pa.array(at)))
                far[at] = _angles((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(far)], names=["label", "dim", "root", "radius"])

    radius = inside.mapInArrow(reach, "label long, dim long, root long, radius double").groupBy("label", "dim", "root").agg(F.max("radius").alias("radius"))
    return radius.join(centres, F.col("root") == F.col("r")).select("label", "dim", "root", "centre", "radius")


def candidates(placed: DataFrame, ball: DataFrame, threshold: float, least: int, rows: int, count: int) -> DataFrame:
    """(ball, id, own, vec): the vectors of other groups that can link with a ball; of two balls, the later one's vectors."""
    n, m = math.ceil(ball.count() / CENTRES), math.ceil(rows / VECTORS)
    deal = lambda column, k: F.pmod(F.xxhash64(column, F.lit("ball")), F.lit(max(1, k))).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(1, k) - 1)))
    some = ball.select("label", "dim").distinct()
    left = ball.select("label", "dim", deal("root", n).alias("x"), each(m).alias("y"), F.lit(0).alias("side"), F.col("root").alias("id"), F.col("root").alias("own"), F.lit(0).alias("size"), "radius", F.col("centre").alias("vec"))
    right = placed.join(some, ["label", "dim"], "left_semi").select("label", "dim", each(n).alias("x"), deal("id", m).alias("y"), F.lit(1).alias("side"), "id", F.col("root").alias("own"), F.col("size").cast("int"), F.lit(0.0).alias("radius"), "vec")
    keys = ("label", "dim", "x", "y")
    both = left.unionByName(right).repartition(count, *keys).sortWithinPartitions(*keys)
    theta = math.acos(threshold) + SLACK

    def near(batches):
        for _, tile in by_run(batches, *keys):
            side, ids, own, size, radius = (tile.column(c).to_numpy() for c in ("side", "id", "own", "size", "radius"))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            vec = tile.column("vec").combine_chunks()
            y = _matrix(vec.take(pa.array(b)))
            for k in range(0, len(a), SLICE):
                c = a[k : k + SLICE]
                hit = _angles(cosines(_matrix(vec.take(pa.array(c))), y)) <= radius[c][:, None] + theta
                hit &= np.where(size[b] >= least, own[b] > ids[c][:, None], True)  # two balls meet once
                for i in range(len(c)):
                    j = b[hit[i]]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), ids[c[i]])), pa.array(ids[j]), pa.array(own[j]), vec.take(pa.array(j))], names=["ball", "id", "own", "vec"])

    return both.mapInArrow(near, "ball long, id long, own long, vec binary")


def bridges(reps: DataFrame, group: DataFrame, threshold: float, least: int, count: int) -> DataFrame:
    """Links (a, b, cos) that join groups of at least `least` vectors with other groups: none is left out, but of the
    links of one tile with one other group the first is told."""
    sizes = group.groupBy("root").agg(F.count("*").alias("size")).withColumnRenamed("root", "r")
    placed = group.join(sizes, F.col("root") == F.col("r")).join(reps, F.col("node") == F.col("id")).select("label", "dim", "root", "size", "id", "vec")
    placed = save(placed, "placed")
    ball = save(balls(placed, least), "balls")
    if ball.isEmpty():
        return reps.sparkSession.createDataFrame([], EDGE)
    found = save(candidates(placed, ball, threshold, least, placed.count(), count), "near")
    tiles = lambda n: F.ceil(F.col(n) / F.lit(TILE)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit("tile")), tiles(n)).cast("int")
    counts = found.groupBy("ball").agg(F.count("*").alias("met"))
    both = counts.join(sizes, F.col("ball") == F.col("r")).select(F.col("ball").alias("k"), "size", "met")
    inside = placed.drop("size").join(both, F.col("root") == F.col("k")).select(F.col("root").alias("ball"), dealt("size").alias("x"), spread("met").alias("y"), F.lit(0).alias("side"), "id", F.col("root").alias("own"), "vec")
    outside = found.join(both, F.col("ball") == F.col("k")).select("ball", spread("size").alias("x"), dealt("met").alias("y"), F.lit(1).alias("side"), "id", "own", "vec")
    met = inside.unionByName(outside).repartition(count, "ball", "x", "y").sortWithinPartitions("ball", "x", "y")

    def link(batches):
        for _, tile in by_run(batches, "ball", "x", "y"):
            side, ids, own = (tile.column(c).to_numpy() for c in ("side", "id", "own"))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            vec = tile.column("vec").combine_chunks()
            cos = cosines(_matrix(vec.take(pa.array(a))), _matrix(vec.take(pa.array(b))))
            i, j = np.nonzero(cos >= threshold)
            _, first = np.unique(own[b[j]], return_index=True)
            if len(first):
                i, j = i[first], j[first]
                yield _edges(ids[a[i]], ids[b[j]], cos[i, j])

    return met.mapInArrow(link, EDGE)


def settle(reps: DataFrame, edges: DataFrame, threshold: float, floor: float, width: int, least: int, count: int) -> tuple[DataFrame, DataFrame]:
    """(edges, groups) after the descent, once no group of at least `least` vectors has a link to the outside."""
    while True:
        edges, group = descend(reps, edges, threshold, floor, width)
        more = save(bridges(reps, group, threshold, least, count), "edges")
        if more.isEmpty():
            return edges, group
        edges = save(edges.unionByName(more).dropDuplicates(["a", "b"]), "edges")


def audit(reps: DataFrame, group: DataFrame, threshold: float, sample: int = AUDIT) -> tuple[float, int]:
    """(recall, links): the mean share of a vector's links, found against all vectors, that fall inside its group, of all
    size classes the least; and how many links the audit met. Without any link it says nothing, and recall is 0.

    A size class holds the groups whose sizes have the same binary logarithm; about `sample` vectors of each are drawn.
    """
    sizes = group.groupBy("root").agg(F.count("*").alias("size")).withColumnRenamed("root", "r")
    level = F.floor(F.log2("size")).cast("int")
    placed = group.join(sizes, F.col("root") == F.col("r")).join(reps, F.col("node") == F.col("id")).select("id", "label", "dim", "vec", "root", level.alias("level"))
    placed = save(placed, "placed")
    share = {r["level"]: min(1.0, sample / r["n"]) for r in placed.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row for each class
    if not share:
        return 1.0, 0
    draw = F.xxhash64("id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("level"))
    chosen = placed.filter(draw < wanted).collect()  # about `sample` vectors of each class
    by: dict[tuple[int, int], list] = {}
    for r in chosen:
        by.setdefault((r["label"], r["dim"]), []).append(r)
    columns = lambda v: [np.array([r[c] for r in v]) for c in ("id", "root", "level")]
    shared = reps.sparkSession.sparkContext.broadcast({k: (*columns(v), np.frombuffer(b"".join(r["vec"] for r in v), np.float32).reshape(len(v), -1).astype(np.float64)) for k, v in by.items()})

    def compare(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            for dim, at, x in _by_dim(batch, 3):
                ids, roots = batch.column(0).to_numpy()[at], batch.column(4).to_numpy()[at]
                for value in np.unique(label[at]):
                    if (int(value), dim) not in shared.value:
                        continue
                    some = label[at] == value
                    queries, own, levels, q = shared.value[int(value), dim]
                    hit = (cosines(q, x[some]) >= threshold) & (queries[:, None] != ids[some])
                    n, held = hit.sum(axis=1), (hit & (own[:, None] == roots[some])).sum(axis=1)
                    k = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (queries[k], levels[k], n[k], held[k])], names=["a", "level", "n", "held"])

    told = placed.mapInArrow(compare, "a long, level long, n long, held long").groupBy("a", "level").agg((F.sum("held") / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    least, links = told.groupBy("level").agg(F.avg("share").alias("share"), F.sum("n").alias("n")).agg(F.min("share"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return least if links else 0.0, int(links)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, floor: float = FLOOR, width: int = WIDTH, tables: int = TABLES, report: dict | None = None) -> DataFrame:
    """One row for each row of df: key, n_links, component_id, kept.

    report gets the audited `recall`, the `audited_links`, and whether groups were compared exactly after it (`exact`).
    """
    spark = df.sparkSession
    sound = _clean(df, key, vector, label)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    digest = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.reverse(F.hex("vec"))).alias("h2")]
    marked = save(sound.select("id", "label", "dim", *digest, "vec"), "vectors")
    same = ["label", "dim", "h1", "h2"]
    classes = marked.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = save(classes, "classes")
    reps = marked.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", *same]).select("id", "label", "dim", "vec")
    reps = save(reps, "reps")
    biggest = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    count = max(parts, math.ceil(reps.count() * tables / ROWS))
    edges = save(start(reps, biggest, 0, tables, count, floor, width), "edges")
    done = tables
    edges, group = settle(reps, edges, threshold, floor, width, width + 1, parts)
    while (told := audit(reps, group, threshold))[0] < RECALL and done < TABLES_MOST:
        more = start(reps, biggest, done, done, count, floor, width)
        done *= 2
        edges, group = settle(reps, save(edges.unionByName(more).dropDuplicates(["a", "b"]), "edges"), threshold, floor, width, width + 1, parts)
    if report is not None:
        report |= {"recall": told[0], "audited_links": told[1], "exact": told[0] < RECALL}
    if told[0] < RECALL:
        edges, group = settle(reps, edges, threshold, floor, width, 1, parts)
    linked = count_links(reps, classes, group, threshold, parts).withColumnRenamed("id", "a")
    roots = group.select(F.col("node"), "root")
    told = classes.join(linked, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    told = told.select(*same, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rep").alias("c"))
    found = _members(marked.select("id", *same), told, same)
    base = df.select(F.col(f"`{key}`").cast("long").alias("v"))
    per_id = found.groupBy("id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    joined = base.join(per_id, F.col("v") == F.col("id"), "left")
    root = F.coalesce("c", "v")
    return joined.select(F.col("v").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("v") == root, F.lit(True)).alias("kept"))


def _members(rows: DataFrame, told: DataFrame, same: list[str]) -> DataFrame:
    """Each row with what is told of its class; a class of very many copies is salted."""
    salts = 64
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    right = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*same, "salt"]).select("id", "n", "c")


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 9: every embedding with its number of links and its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
