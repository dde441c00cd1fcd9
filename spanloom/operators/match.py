"""Row-pattern matching of a compiled catalog over token rows, in passes over whole documents.

Tokens are looked up in the predicates' fields once for each distinct value of a batch. A segment stands where all of its
steps' hits do; segments join over gaps by the number of clause marks before them, which is equal on both sides of a gap
exactly if no mark stands inside it; contexts are the best sequences that end or begin at a core. All of it is arrays of
places (see ordered.py): no token is shuffled or kept, and matches leave a batch as numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.catalog import FIELDS, Compiled
from .ordered import KINDS, Batch, Tokens, ragged

CAPTURES = "array<struct<name:string,token_start:int,token_end:int>>"
#: Rows of a catalog table up to which it is broadcast; a catalog does not grow with the data.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Found:
    """Matches of a batch, an entry for each: places (start is the core's), path and captures as padded rows.

    Of captures there are names (numbers; -1 is none), starts and ends, the taken ones first.
    """

    vid: np.ndarray
    token_start: np.ndarray
    token_end: np.ndarray
    core: np.ndarray
    context: np.ndarray
    start: np.ndarray
    path: np.ndarray
    caps: np.ndarray  # match, capture, (name, start, end)


@dataclass
class _Ways:
    """Matches of the forms of one sequence: end is exclusive."""

    start: np.ndarray
    end: np.ndarray
    spec: np.ndarray
    path: np.ndarray
    caps: np.ndarray

    def take(self, rows) -> _Ways:
        return _Ways(*[getattr(self, f)[rows] for f in ("start", "end", "spec", "path", "caps")])


def _stack(blocks: list[np.ndarray], fill: int) -> np.ndarray:
    """Blocks one below the other, as wide as the widest."""
    wide = max(b.shape[1] for b in blocks)
    return np.concatenate([b if b.shape[1] == wide else np.concatenate([b, np.full((len(b), wide - b.shape[1], *b.shape[2:]), fill, b.dtype)], axis=1) for b in blocks])


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """The first row of each key by order; the most important column comes first."""
    rows = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[rows][1:] != k[rows][:-1]
    return rows[new]


def _columns(block: np.ndarray) -> list[np.ndarray]:
    return [block[:, i] for i in range(block.shape[1])]


class Matcher:
    """A compiled catalog for passes; it goes to the workers."""

    def __init__(self, catalog: Compiled):
        self.conjunctions = [(pred, [(f, v) for f, v in zip(FIELDS, values) if v is not None]) for _, pred, *values in catalog.conjunctions]
        self.fields = [f for f in FIELDS if any(f == g for _, fields in self.conjunctions for g, _ in fields)]
        self.steps: dict[int, list[int]] = {}
        for seg, offset, pred, _ in sorted(catalog.seg_steps):
            self.steps.setdefault(seg, []).append(pred)
        segs: dict[int, list[tuple]] = {}
        for form, _, seg, length, low, high in sorted(catalog.segs):
            segs.setdefault(form, []).append((seg, length, low, high))
        self.names = sorted({c[0] for f in catalog.forms for c in f[6]})
        self.forms: dict[tuple[int, str], list[tuple]] = {}
        for form, vid, role, _, spec, path, caps in catalog.forms:
            self.forms.setdefault((vid, role), []).append((segs[form], spec, path, [(self.names.index(n), s, o, g) for n, s, o, g in caps]))
        self.variants = [(v[0], v[15], v[16], v[17], v[20], v[21], v[22], v[23]) for v in catalog.variants]

    @property
    def needs(self) -> list[str]:
        """The columns of token rows that are read."""
        return [*self.fields, "__kind"]

    def find(self, batch: Batch) -> Found:
        return _Search(self, batch).found()


class _Search:
    def __init__(self, matcher: Matcher, batch: Batch):
        self.m, self.places = matcher, batch.places
        places = self.places
        self.kind = places.spread(batch.code("kind"), KINDS["edge"])
        counted = np.cumsum(self.kind > 0)
        self.pre = np.concatenate([[0], counted[:-1]])
        codes = {f: batch.field(f) for f in matcher.fields}
        self.hits: dict[int, np.ndarray] = {}
        for pred, fields in matcher.conjunctions:
            if not all(v in codes[f][0] for f, v in fields):
                continue
            rows = None
            for f, v in fields:
                known, values = codes[f]
                rows = np.flatnonzero(values == known[v]) if rows is None else rows[values[rows] == known[v]]
            at = places.at[rows]
            self.hits[pred] = np.union1d(self.hits[pred], at) if pred in self.hits else at
        self.stands: dict[int, np.ndarray] = {}
        self.known: dict[tuple[int, str], _Ways] = {}

    @staticmethod
    def _among(places: np.ndarray, some: np.ndarray) -> np.ndarray:
        if not len(some):
            return np.zeros(len(places), bool)
        return some[np.minimum(np.searchsorted(some, places), len(some) - 1)] == places

    def segment(self, seg: int) -> np.ndarray:
        """Places where a segment with steps begins."""
        if seg not in self.stands:
            none = np.zeros(0, np.int64)
            sets = [(self.hits.get(p, none), o) for o, p in enumerate(self.m.steps[seg])]
            fewest, offset = min(sets, key=lambda s: len(s[0]))
            begin = fewest - offset
            for hits, o in sets:
                begin = begin[self._among(begin + o, hits)]
            self.stands[seg] = begin
        return self.stands[seg]

    def form(self, segs: list[tuple], spec: int, path: list[int], caps: list[tuple]) -> _Ways:
        """All ways through a form: a state's next segment begins one of the gap's widths behind its end."""
        seg, length, _, _ = segs[0]
        if length:
            begin = self.segment(seg)
            starts, ends, k = [begin], [begin + length], 1
        elif len(segs) > 1 and segs[1][1]:  # led by a gap: the segment behind it says where
            seg, length, low, high = segs[1]
            begin = self.segment(seg)
            led = [(begin - w, begin) for w in range(low, high + 1)]
            led = [(p[ok], b[ok]) for p, b in led for ok in [(p >= 0) & (self.pre[np.maximum(p, 0)] == self.pre[b])]]
            p, b = (np.concatenate(x) for x in zip(*led))
            starts, ends, k = [p, b], [p, b + length], 2
        else:
            every = np.arange(1, self.places.size)
            starts, ends, k = [every], [every], 1
        for seg, length, low, high in segs[k:]:
            rows, nexts = [], []
            for w in range(low, high + 1):
                to = ends[-1] + w
                ok = to < self.places.size
                ok[ok] = self.pre[to[ok]] == self.pre[ends[-1][ok]]
                if length:
                    ok[ok] = self._among(to[ok], self.segment(seg))
                chosen = np.flatnonzero(ok)
                rows.append(chosen)
                nexts.append(to[chosen])
            rows, to = np.concatenate(rows), np.concatenate(nexts)
            starts, ends = [*[s[rows] for s in starts], to], [*[e[rows] for e in ends], to + length]
        n = len(starts[0])
        taken = np.empty((n, len(path)), np.int32)
        for i, x in enumerate(path):
            taken[:, i] = x if x >= 0 else starts[-x] - ends[-x - 1]
        made = np.full((n, len(caps), 3), -1, np.int64)
        for i, (name, seg, off, gap) in enumerate(caps):
            first = (starts[seg] if seg < len(starts) else ends[-1]) + off
            last = first + (starts[gap + 1] - ends[gap] if gap >= 0 else 1) - 1
            some = last >= first
            made[some, i] = np.stack([np.full(some.sum(), name), first[some], last[some]], axis=1)
        return _Ways(starts[0], ends[-1], np.full(n, spec, np.int32), taken, made)

    def ways(self, vid: int, role: str) -> _Ways:
        if (vid, role) not in self.known:
            found = [self.form(*f) for f in self.m.forms[vid, role]]
            whole = _Ways(*[np.concatenate([getattr(w, f) for w in found]) for f in ("start", "end", "spec")], _stack([w.path for w in found], 0), _stack([w.caps for w in found], -1))
            if role == "left":  # the best one that ends at a place
                whole = whole.take(_first_of([whole.end], [-whole.spec, -whole.start, *_columns(whole.path)]))
            elif role == "right":  # the best one that begins there
                whole = whole.take(_first_of([whole.start], [-whole.spec, -whole.end, *[-c for c in _columns(whole.path)]]))
            self.known[vid, role] = whole
        return self.known[vid, role]

    def found(self) -> Found:
        made = []
        for vid, left_boundary, right_boundary, absorb, has_left, has_right, left_of, right_of in self.m.variants:
            core = self.ways(vid, "core")
            ok = core.end > core.start
            for boundary, side in ((left_boundary, self.kind[core.start - 1]), (right_boundary, self.kind[core.end])):
                if boundary is not None:
                    ok &= side >= (KINDS["clause"] if boundary == "clause" else KINDS["sentence"])
            core = core.take(ok)
            context = np.full(len(core.start), sum(b is not None for b in (left_boundary, right_boundary)), np.int32)
            token_start, caps = core.start, [core.caps]
            if has_left:
                best = self.ways(left_of, "left")
                rows = self._among(core.start, best.end)
                core, context = core.take(rows), context[rows]
                best = best.take(np.searchsorted(best.end, core.start))
                context, caps, token_start = context + best.spec, [best.caps, core.caps], best.start
            if has_right:
                best = self.ways(right_of, "right")
                rows = self._among(core.end, best.start)
                core, context, caps, token_start = core.take(rows), context[rows], [c[rows] for c in caps], token_start[rows]
                best = best.take(np.searchsorted(best.start, core.end))
                context, caps = context + best.spec, [*caps, best.caps]
            joined = np.concatenate(caps, axis=1)
            if joined.shape[1]:
                order = np.argsort(joined[:, :, 0] < 0, axis=1, kind="stable")
                joined = np.take_along_axis(joined, order[:, :, None], axis=1)
            token_start = token_start if absorb and has_left else core.start
            rows = _first_of([token_start, core.end, core.spec, context, *_columns(joined.reshape(len(joined), 3 * joined.shape[1]))], [core.start, *_columns(core.path)])
            made.append(Found(np.full(len(rows), vid, np.int32), token_start[rows], core.end[rows] - 1, core.spec[rows], context[rows], core.start[rows], core.path[rows], joined[rows]))
        flat = {f: np.concatenate([getattr(x, f) for x in made]) for f in ("vid", "token_start", "token_end", "core", "context", "start")}
        return Found(**flat, path=_stack([x.path for x in made], 0), caps=_stack([x.caps for x in made], -1))


def captures_array(matcher: Matcher, caps: np.ndarray, base: np.ndarray) -> pa.Array:
    """Captures as lists; base has each match's document's first place."""
    taken = caps[:, :, 0] >= 0
    flat = caps[taken]
    less = np.broadcast_to(base[:, None], taken.shape)[taken]
    names = pa.array(matcher.names, pa.string()).take(pa.array(flat[:, 0]))
    fields = [pa.field("name", pa.string()), pa.field("token_start", pa.int32()), pa.field("token_end", pa.int32())]
    items = pa.StructArray.from_arrays([names, pa.array((flat[:, 1] - less).astype(np.int32)), pa.array((flat[:, 2] - less).astype(np.int32))], fields=fields)
    return pa.ListArray.from_arrays(ragged(taken.sum(axis=1)), items)


def candidates(tokens: DataFrame | Tokens, catalog: Compiled) -> DataFrame:
    """Every distinct match with its evidence; `discovery` is the order of search, `identity` the order of listing."""
    tokens = tokens if isinstance(tokens, Tokens) else Tokens.of_rows(tokens)
    spark, matcher = tokens.df.sparkSession, Matcher(catalog)
    lengths = np.array([max(len(f[2]) for f in matcher.forms[v[0], "core"]) for v in matcher.variants])

    def work(batch):
        found = matcher.find(batch)
        doc = batch.places.doc(found.start)
        base = batch.places.base[doc]
        numbers = [found.token_start - base, found.token_end - base, found.core, found.context, found.start - base]
        taken = np.arange(found.path.shape[1]) < lengths[found.vid][:, None]
        path = pa.ListArray.from_arrays(ragged(taken.sum(axis=1)), pa.array(found.path[taken].astype(np.int32)))
        return [batch.ids.take(pa.array(doc)), pa.array(found.vid), *[pa.array(x.astype(np.int32)) for x in numbers], path, captures_array(matcher, found.caps, base)]

    found = tokens.run(work, f"vid int, token_start int, token_end int, core_specificity int, context_specificity int, start int, path array<int>, captures {CAPTURES}", matcher.needs)
    made = found.join(_small(catalog.table(spark, "variants"), len(catalog.variants)), "vid").select(
        "doc_id", "rule_id", "variant_id", "rule_name", "jlpt", "meaning_en", "hint", "sense_id", "ambiguity_group",
        F.struct(F.col("source_id").alias("id"), F.col("source_label").alias("label")).alias("source"),
        "captures", "token_start", "token_end", "fallback", "core_specificity", "context_specificity", "priority", "wildcard_steps", "optional_steps",
        F.struct("rule_ord", "variant_ord", "start", "path").alias("discovery"),
    )
    return made.withColumn("identity", F.struct("token_start", "token_end", "rule_id", "variant_id", "core_specificity", "context_specificity", "wildcard_steps", "optional_steps", "discovery"))


# ---------------------------------------------------------------------------------------------------
# One reading of each occurrence


def strength(c: Column) -> Column:
    """What makes a candidate better: larger is better; ids break ties, smaller first."""
    return F.struct((~c["fallback"]).alias("a"), c["core_specificity"].alias("b"), c["context_specificity"].alias("c"), c["priority"].alias("d"), (c["token_end"] - c["token_start"]).alias("e"))


def _better(x: Column, y: Column) -> Column:
    ids = lambda c: F.struct(c["rule_id"].alias("r"), c["variant_id"].alias("v"))
    return (strength(x) > strength(y)) | ((strength(x) == strength(y)) & (ids(x) < ids(y)))


def resolve(found: DataFrame) -> DataFrame:
    """First match of each (rule, variant, start); of each span one reading for each rule or sense; of each span one
    for each ambiguity group.

    Equality by rule or sense is not transitive, so the second step is a fold over a span's candidates in their
    listing order; a span has at most as many as the catalog has variants. Candidates are shuffled once, by document.
    """
    found = found.repartition("doc_id")
    occurrence = Window.partitionBy("doc_id", "rule_id", "variant_id", "token_start").orderBy("discovery")
    first = found.withColumn("__n", F.row_number().over(occurrence)).filter("__n = 1").drop("__n")
    columns = [c for c in first.columns if c not in ("doc_id", "identity")]
    packed = first.groupBy("doc_id", "token_start", "token_end").agg(F.array_sort(F.collect_list(F.struct("identity", *columns))).alias("all"))

    def keep(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda e: P.same_sense_or_rule(e, x)), True)
        put = F.transform(acc, lambda e, i: F.when(i == at - 1, x).otherwise(e))
        return F.when(at == 0, F.array_append(acc, x)).when(_better(x, F.element_at(acc, F.greatest(at, F.lit(1)).cast("int"))), put).otherwise(acc)

    folded = packed.select("doc_id", F.explode(F.aggregate(F.slice("all", 2, F.size("all")), F.slice("all", 1, 1), keep)).alias("x")).select("doc_id", "x.*")
    ids = Window.partitionBy("doc_id", "token_start", "token_end", "ambiguity_group").orderBy(strength_columns(), "rule_id", "variant_id")
    ranked = folded.withColumn("__n", F.when(F.col("ambiguity_group").isNull(), 1).otherwise(F.row_number().over(ids)))
    return ranked.filter("__n = 1").drop("__n")


def strength_columns() -> Column:
    """A sort key by which the best candidate comes first."""
    return F.struct(F.col("fallback"), -F.col("core_specificity"), -F.col("context_specificity"), -F.col("priority"), F.col("token_start") - F.col("token_end"))


def probe(found: DataFrame, owners: DataFrame) -> DataFrame:
    """Candidates of the rule that owns each document: owners has doc_id and rule_id."""
    return found.join(owners.select("doc_id", "rule_id"), ["doc_id", "rule_id"])
