"""Ranked selection of matches that don't overlap, with what each of the others lost against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import jlpt_level, normalize
from ..sources.catalog import Compiled
from .match import CAPTURES, Found, Matcher, captures_array
from .ordered import Batch, Tokens, ragged
from .reuse import shared
from .segment import Phrases, opening_table

CONTAINED, OVERLAPS = "contained_by_stronger_match", "overlaps_stronger_match"


def aligned(found: DataFrame, phrases: DataFrame | None) -> DataFrame:
    """found with `aligned`: inside one phrase, or from a phrase's start to a phrase's end.

    phrases has the token rows of segment.phrases(); positions that no phrase covers are neutral.
    """
    if phrases is None:
        return found.withColumn("aligned", F.lit(True))
    at = phrases.select(F.col("doc_id").alias("d"), F.col("position").alias("p"), F.struct("sentence_id", "bunsetsu_id").alias("phrase"), "bunsetsu_start", "bunsetsu_end")
    first = at.select(F.col("d").alias("d1"), F.col("p").alias("p1"), F.col("phrase").alias("phrase1"), F.col("bunsetsu_start").alias("s1"))
    last = at.select(F.col("d").alias("d2"), F.col("p").alias("p2"), F.col("phrase").alias("phrase2"), F.col("bunsetsu_end").alias("e2"))
    met = found.join(first, (F.col("doc_id") == F.col("d1")) & (F.col("token_start") == F.col("p1")), "left")
    met = met.join(last, (F.col("doc_id") == F.col("d2")) & (F.col("token_end") == F.col("p2")), "left")
    ok = (F.col("phrase1") == F.col("phrase2")) | ((F.col("token_start") == F.col("s1")) & (F.col("token_end") == F.col("e2")))
    return met.select(*found.columns, F.coalesce(ok, F.lit(True)).alias("aligned"))


def rank_key() -> Column:
    """The total order of candidates, strongest first; `identity` makes it total where all evidence is equal."""
    return F.struct(
        F.col("fallback"),
        -F.col("priority"),
        ~F.col("aligned"),
        F.col("token_start") - F.col("token_end"),
        -F.col("core_specificity"),
        -F.col("context_specificity"),
        F.col("wildcard_steps"),
        F.col("optional_steps"),
        -jlpt_level(F.col("jlpt")),
        F.col("rule_id"),
        F.col("variant_id"),
        F.col("token_start"),
        F.col("token_end"),
        F.col("identity"),
    )


def grouped(found: DataFrame) -> DataFrame:
    """Matches of one span, name and meaning as one: the best one's data, and the provenance of all.

    `rank` orders the matches of a document; `id` is match-start-end, with a number from the second of a span on.
    """
    ranked = found.withColumn("key", rank_key())
    score = F.struct("fallback", "priority", (F.col("token_end") - F.col("token_start") + 1).alias("span_length"), "core_specificity", "context_specificity", "wildcard_steps", "optional_steps")
    shown = F.struct("rule_name", "jlpt", "meaning_en", "hint", "sense_id", "ambiguity_group", "captures", score.alias("score"))
    one = ranked.groupBy("doc_id", "token_start", "token_end", normalize(F.col("rule_name")).alias("n1"), normalize(F.col("meaning_en")).alias("n2")).agg(
        F.min("key").alias("key"),
        F.min_by(shown, F.col("key")).alias("m"),
        F.array_sort(F.collect_set(F.struct(F.col("source.id").alias("s"), F.col("rule_id").alias("r"), F.col("variant_id").alias("v"), F.col("source")))).alias("p"),
    )
    provenance = F.transform("p", lambda x: F.struct(x["source"].alias("source"), x["r"].alias("rule_id"), x["v"].alias("variant_id")))
    n = F.row_number().over(Window.partitionBy("doc_id", "token_start", "token_end").orderBy("key")) - 1
    base = F.format_string("match-%d-%d", "token_start", "token_end")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
    out = one.withColumn("n", n).withColumn("rank", rank)
    return out.select("doc_id", F.when(F.col("n") == 0, base).otherwise(F.concat(base, F.lit("-"), F.col("n").cast("string"))).alias("id"), "m.*", "token_start", "token_end", provenance.alias("provenance"), "rank")


def select(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(primary, secondary) of grouped matches: strongest first, a match goes to the secondary ones if it overlaps a
    stronger primary one, which blocks it.

    Overlaps don't leave an island of overlapping spans, so each island is folded by itself, in rank order.
    """
    by = Window.partitionBy("doc_id").orderBy("token_start", "token_end", "rank")
    reach = F.max("token_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = matches.withColumn("__new", F.coalesce(F.col("token_start") > reach, F.lit(True)).cast("int"))
    placed = opened.withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    span = F.struct("rank", "token_start", "token_end", "id")
    folded = placed.groupBy("doc_id", "__island").agg(F.array_sort(F.collect_list(span)).alias("all"))

    def accept(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda p: P.overlaps(p["token_start"], p["token_end"], x["token_start"], x["token_end"])), acc).otherwise(F.array_append(acc, x))

    chosen = F.aggregate(F.slice("all", 2, F.size("all")), F.slice("all", 1, 1), accept)
    folded = folded.select("doc_id", "all", chosen.alias("kept"))
    first = lambda x: F.get(F.filter("kept", lambda p: P.overlaps(p["token_start"], p["token_end"], x["token_start"], x["token_end"])), F.lit(0))  # noqa: E731  the kept are in rank order
    told = folded.select("doc_id", F.explode(F.transform("all", lambda x: F.struct(x["rank"].alias("rank"), first(x).alias("by")))).alias("x")).select(F.col("doc_id").alias("d"), F.col("x.rank").alias("r"), F.col("x.by").alias("by"))
    both = shared(matches.join(told, (F.col("doc_id") == F.col("d")) & (F.col("rank") == F.col("r"))).drop("d", "r"))
    primary = both.filter(F.col("by.rank") == F.col("rank")).drop("by")
    reason = F.when(P.contains(F.col("by.token_start"), F.col("by.token_end"), F.col("token_start"), F.col("token_end")), CONTAINED).otherwise(OVERLAPS)
    second = both.filter(F.col("by.rank") != F.col("rank")).withColumns({"reason": reason, "blocked_by": F.col("by.id")}).drop("by")
    # Numbers of a span follow its match ids as strings.
    n = F.row_number().over(Window.partitionBy("doc_id", "token_start", "token_end").orderBy("id")) - 1
    return primary, second.withColumn("secondary_id", F.format_string("secondary-%d-%d-%d", "token_start", "token_end", n))


def rank(found: DataFrame, phrases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(primary, secondary) of candidates; without phrases, all are aligned."""
    return select(shared(grouped(aligned(found, phrases))))


def in_order(matches: DataFrame) -> DataFrame:
    """Matches in the order in which they are shown."""
    return matches.orderBy("doc_id", "token_start", "token_end", "id")


# ---------------------------------------------------------------------------------------------------
# The same in a pass over whole documents


@dataclass
class Ranked:
    """Ranked matches of a batch, strongest first in each document; places where not said otherwise."""

    best: np.ndarray  # number of the best one in Found
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # number
    n: np.ndarray  # number in its span
    rank: np.ndarray
    by: np.ndarray  # number of the match that it lost against, or its own
    among: np.ndarray  # secondary ones: number in their span
    provenance: tuple[np.ndarray, np.ndarray]  # vids, and how many each match has
    cover: np.ndarray  # of each place, the primary match there; -1 is none

    def shown(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the primary and of the secondary ones, in the order in which they are shown."""
        own = self.by == np.arange(len(self.by))
        primary, second = np.flatnonzero(own), np.flatnonzero(~own)
        return primary[np.argsort(self.start[primary])], second[np.lexsort([self.among[second], self.end[second], self.start[second]])]


class Ranker:
    """Ranking for passes; it goes to the workers."""

    def __init__(self, spark: SparkSession, catalog: Compiled):
        self.matcher, self.table = Matcher(catalog), opening_table(spark)
        told = catalog.table(spark, "variants").select("*", normalize(F.col("rule_name")).alias("n1"), normalize(F.col("meaning_en")).alias("n2"), jlpt_level(F.col("jlpt")).alias("level"))
        rows = sorted(told.collect(), key=lambda r: r["vid"])  # a row for each variant of the catalog
        text = lambda x: (x is not None, (x or "").encode())
        place = lambda keys: {k: i for i, k in enumerate(sorted(set(keys)))}
        column = lambda name: np.array([int(r[name]) for r in rows])
        ids = [(text(r["rule_id"]), text(r["variant_id"])) for r in rows]
        names = [(r["n1"], r["n2"]) for r in rows]
        sources = [(text(r["source_id"]), *i) for r, i in zip(rows, ids)]
        self.id = np.array([place(ids)[i] for i in ids])
        self.name = np.array([list(dict.fromkeys(names)).index(n) for n in names])
        self.source = np.array([place(sources)[s] for s in sources])
        self.fallback, self.priority, self.wild, self.optional, self.level = (column(c) for c in ("fallback", "priority", "wildcard_steps", "optional_steps", "level"))
        self.rule_names = [r["rule_name"] for r in rows]
        self.sources = [{"source": {"id": r["source_id"], "label": r["source_label"]}, "rule_id": r["rule_id"], "variant_id": r["variant_id"]} for r in rows]

    @property
    def needs(self) -> list[str]:
        return [*self.matcher.needs, *Phrases.NEEDS]

    def find(self, batch: Batch) -> tuple[Found, Phrases, Ranked]:
        phrases, found = Phrases(batch, self.table), self.matcher.find(batch)
        return found, phrases, self._rank(batch, found, phrases)

    def _rank(self, batch: Batch, f: Found, p: Phrases) -> Ranked:
        doc, s, e, v = batch.places.doc(f.token_start), f.token_start, f.token_end, f.vid
        same = (p.start[s] == p.start[e]) | ((s == p.start[s]) & (e == p.end[e]))
        path = [f.path[:, i] for i in range(f.path.shape[1])]
        keys = [doc, self.fallback[v], -self.priority[v], ~same, s - e, -f.core, -f.context, self.wild[v], self.optional[v], -self.level[v], self.id[v], s, e, v, f.start, *path]
        order = np.lexsort(keys[::-1])
        key = np.empty(len(v), np.int64)
        key[order] = np.arange(len(v))
        # Matches of one span, name and meaning are one, which the best of them stands for.
        rows = np.lexsort([key, self.name[v], e, s])
        new = np.ones(len(v), bool)
        new[1:] = np.any([x[rows][1:] != x[rows][:-1] for x in (s, e, self.name[v])], axis=0)
        group = np.cumsum(new) - 1
        best = rows[new]
        told = np.lexsort([self.source[v[rows]], group])
        pair = np.stack([group[told], self.source[v[rows]][told]])
        once = np.ones(len(v), bool)
        once[1:] = np.any(pair[:, 1:] != pair[:, :-1], axis=0)
        vids, counts = v[rows][told][once], np.bincount(group[told][once], minlength=len(best))
        # In rank order.
        order = np.argsort(key[best])
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
        counts = counts[order]
        vids = vids[np.repeat(begin - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())] if len(counts) else vids
        best = best[order]
        s, e, doc = s[best], e[best], doc[best]
        rank = _within(doc) + 1
        spans = np.lexsort([np.arange(len(s)), e, s])
        n = np.empty(len(s), np.int64)
        n[spans] = _within(s[spans], e[spans])
        by, cover = _select(s, e, batch.places.size)
        among = np.zeros(len(s), np.int64)
        second = np.flatnonzero(by != np.arange(len(s)))
        told = np.array([i for _, i in sorted(("" if i == 0 else str(i), i) for i in range(int(n.max(initial=0)) + 1))])
        string = np.empty(len(told), np.int64)
        string[told] = np.arange(len(told))  # numbers of a span follow its match ids as strings
        second = second[np.lexsort([string[n[second]], e[second], s[second]])]
        among[second] = _within(s[second], e[second])
        return Ranked(best, s, e, doc, n, rank, by, among, (vids, counts), cover)


def _within(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 within runs of equal keys."""
    at = np.arange(len(keys[0]))
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _select(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What each match lost against (itself, if against nothing), strongest first; and the kept one on each place."""
    none = len(start)
    cover, by = [none] * size, [0] * none
    for i, (s, e) in enumerate(zip(start.tolist(), end.tolist())):
        first = min(cover[s : e + 1])
        if first == none:
            cover[s : e + 1] = [i] * (e + 1 - s)
            first = i
        by[i] = first
    cover = np.array(cover)
    return np.array(by, np.int64), np.where(cover == none, -1, cover)


_SOURCE = "struct<source:struct<id:string,label:string>,rule_id:string,variant_id:string>"
_NUMBERS = ("vid", "n", "token_start", "token_end", "rank", "core_specificity", "context_specificity", "by_n", "by_start", "by_end", "among", "sentence1", "bunsetsu1", "sentence2", "bunsetsu2")


def match_ids(start: np.ndarray, end: np.ndarray, n: np.ndarray) -> list[str]:
    """match_id() of positions."""
    return [f"match-{s}-{e}" if not k else f"match-{s}-{e}-{k}" for s, e, k in zip(start.tolist(), end.tolist(), n.tolist())]


def match_id(start: str, end: str, n: str) -> Column:
    base = F.format_string("match-%d-%d", start, end)
    return F.when(F.col(n) == 0, base).otherwise(F.concat(base, F.lit("-"), F.col(n).cast("string")))


def ranked(tokens: Tokens, catalog: Compiled) -> tuple[DataFrame, DataFrame]:
    """(primary, secondary) as rank() gives them of the candidates and phrases of tokens, and the sentence and phrase of
    either end (sentence1, bunsetsu1, sentence2, bunsetsu2); nothing is shuffled or kept, each is a pass of its own."""
    ranker = Ranker(tokens.df.sparkSession, catalog)

    def rows(primary: bool) -> DataFrame:
        def work(batch):
            found, phrases, r = ranker.find(batch)
            own = r.by == np.arange(len(r.by))
            wanted = np.flatnonzero(own == primary)
            best, s, e, by = r.best[wanted], r.start[wanted], r.end[wanted], r.by[wanted]
            base = batch.places.base[r.doc[wanted]]
            numbers = [
                found.vid[best], r.n[wanted], s - base, e - base, r.rank[wanted], found.core[best], found.context[best], r.n[by], r.start[by] - base, r.end[by] - base, r.among[wanted],
                phrases.sentence[s], phrases.number[s], phrases.sentence[e], phrases.number[e],
            ]
            vids, counts = r.provenance
            vids = vids[np.repeat(own == primary, counts)]
            sources = pa.array(ranker.sources, pa.struct([("source", pa.struct([("id", pa.string()), ("label", pa.string())])), ("rule_id", pa.string()), ("variant_id", pa.string())]))
            provenance = pa.ListArray.from_arrays(ragged(counts[wanted]), sources.take(pa.array(vids)))
            return [batch.ids.take(pa.array(r.doc[wanted])), *[pa.array(x.astype(np.int32)) for x in numbers], captures_array(ranker.matcher, found.caps[best], base), provenance]

        made = tokens.run(work, ", ".join(f"{c} int" for c in _NUMBERS) + f", captures {CAPTURES}, provenance array<{_SOURCE}>", ranker.needs)
        variants = catalog.table(made.sparkSession, "variants").select("vid", "rule_name", "jlpt", "meaning_en", "hint", "sense_id", "ambiguity_group", "fallback", "priority", "wildcard_steps", "optional_steps")
        score = F.struct("fallback", "priority", (F.col("token_end") - F.col("token_start") + 1).alias("span_length"), "core_specificity", "context_specificity", "wildcard_steps", "optional_steps")
        ends = ("sentence1", "bunsetsu1", "sentence2", "bunsetsu2")
        more = () if primary else ("by_n", "by_start", "by_end", "among")
        return made.filter("doc_id IS NOT NULL").join(F.broadcast(variants), "vid").select(
            "doc_id", match_id("token_start", "token_end", "n").alias("id"), "rule_name", "jlpt", "meaning_en", "hint", "sense_id", "ambiguity_group", "captures", score.alias("score"), "token_start", "token_end", "provenance", "rank", *ends, *more
        )

    second = rows(False)
    reason = F.when(P.contains(F.col("by_start"), F.col("by_end"), F.col("token_start"), F.col("token_end")), CONTAINED).otherwise(OVERLAPS)
    second = second.withColumns({"reason": reason, "blocked_by": match_id("by_start", "by_end", "by_n"), "secondary_id": F.format_string("secondary-%d-%d-%d", "token_start", "token_end", "among")})
    return rows(True), second.drop("by_n", "by_start", "by_end", "among")


def node_of() -> Column:
    """The node of the tree that a match of ranked() is attached to; see tree.owners()."""
    sentence = F.col("sentence1") == F.col("sentence2")
    inside = F.when(sentence & (F.col("bunsetsu1") == F.col("bunsetsu2")), F.format_string("bunsetsu-%d-%d", "sentence1", "bunsetsu1"))
    return inside.when(sentence, F.format_string("sentence-%d", "sentence1")).otherwise("document-0")


def cover(tokens: Tokens, catalog: Compiled) -> DataFrame:
    """(doc_id, position, owner): the primary match that covers a token, or root."""
    ranker = Ranker(tokens.df.sparkSession, catalog)

    def work(batch):
        _, _, r = ranker.find(batch)
        places = batch.places
        doc = places.doc(places.at)
        at = r.cover[places.at]
        some = at >= 0
        # Each match's id is made once; tokens take it by number.
        kept = np.flatnonzero(r.by == np.arange(len(r.by)))
        base = places.base[r.doc[kept]]
        ids = match_ids(r.start[kept] - base, r.end[kept] - base, r.n[kept])
        number = np.full(len(at), len(kept))
        number[some] = np.searchsorted(kept, at[some])
        owner = pa.array([*ids, "root"], pa.string()).take(pa.array(number))
        return [batch.ids.take(pa.array(doc)), pa.array((places.at - places.base[doc]).astype(np.int32)), owner]

    return tokens.run(work, "position int, owner string", ranker.needs).withColumn("owner", F.when(F.col("doc_id").isNull(), "root").otherwise(F.col("owner")))
