"""Text renderings as rows: lines of phrases, traces, outlines, graph descriptions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import display_width, dot_escape
from ..sources.catalog import Compiled
from . import tree
from .ordered import Tokens, ragged
from .rank import Ranker
from .tokens import FEATURES


def _joined(df: DataFrame, by: list[str], order: str, value: Column, separator: str, out: str) -> DataFrame:
    """Values of each group in order, joined."""
    packed = df.select(*by, F.struct(F.col(order).alias("o"), value.alias("v")).alias("s")).groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("l"))
    return packed.select(*by, F.array_join(F.transform("l", lambda s: s["v"]), separator).alias(out))


def phrase_lines(phrases: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, line): 文n: [a·b] [c].

    Each token brings what stands before and behind it, so that a sentence is put together once.
    """
    before = F.when(F.col("position") > F.col("bunsetsu_start"), "·").when(F.col("bunsetsu_id") > 0, " [").otherwise("[")
    value = F.concat(before, "surface", F.when(F.col("position") == F.col("bunsetsu_end"), "]").otherwise(""))
    lines = _joined(phrases, ["doc_id", "sentence_id"], "position", value, "", "l")
    return lines.select("doc_id", "sentence_id", F.concat(F.lit("文"), (F.col("sentence_id") + 1).cast("string"), F.lit(": "), "l").alias("line"))


def trace_lines(decisions: DataFrame) -> DataFrame:
    """(doc_id, position, line): whether a token opens a phrase, and why."""
    pos = F.when(F.col("pos2") == "", F.col("pos1")).otherwise(F.concat_ws("·", "pos1", "pos2"))
    mark = F.when(F.col("starts_new"), "┌ NEW   ").otherwise("│ attach")
    return decisions.select("doc_id", "position", F.concat_ws(" ", mark, F.rpad("surface", 8, " "), F.rpad(pos, 18, " "), "reason").alias("line"))


def token_table(tokens: DataFrame) -> DataFrame:
    """(doc_id, position, line): padded columns of a token."""
    cells = [F.rpad(F.col(c), n, " ") for c, n in (("surface", 12), ("pos1", 10), ("pos2", 10), ("base_form", 12), ("reading", 12))]
    return tokens.select("doc_id", "position", F.concat_ws(" ", F.lpad(F.col("position").cast("string"), 4, " "), *cells).alias("line"))


def raw_fields(tokens: DataFrame) -> DataFrame:
    """(doc_id, position, field, value): features that are given, by their number."""
    fields = F.array("surface", *FEATURES)
    return tokens.select("doc_id", "position", F.posexplode(fields).alias("field", "value")).filter(~F.col("value").isin("", "*"))


def outline(a) -> DataFrame:
    """(doc_id, line_number, line): an analysis' tree, depth first in the order of children.

    Trees have four levels, so the way to a node is three joins and no recursion.
    """
    nodes, edges = a.nodes, a.edges.select("doc_id", "parent_id", "child_id", "order")
    up = nodes.select("doc_id", "id", F.array().cast("array<int>").alias("way"), F.col("id").alias("top"))
    for _ in range(3):
        e = edges.select(F.col("doc_id").alias("d"), F.col("child_id").alias("c"), "parent_id", F.col("order").cast("int").alias("o"))
        up = up.join(e, (F.col("doc_id") == F.col("d")) & (F.col("top") == F.col("c")), "left")
        up = up.select("doc_id", "id", F.when(F.col("o").isNull(), F.col("way")).otherwise(F.concat(F.array("o"), "way")).alias("way"), F.coalesce("parent_id", "top").alias("top"))
    words = a.tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "surface"))), lambda x: x["surface"]).alias("surfaces"))
    names = nodes.select("doc_id", "id", F.posexplode("match_ids").alias("k", "m")).join(a.primary.select("doc_id", F.col("id").alias("m"), "rule_name"), ["doc_id", "m"])
    labels = _joined(names, ["doc_id", "id"], "k", F.col("rule_name"), ", ", "names")
    all_ = nodes.join(up.select("doc_id", "id", "way"), ["doc_id", "id"]).join(words, "doc_id", "left").join(labels, ["doc_id", "id"], "left")
    span = F.when(F.col("token_start").isNull(), "[--]").otherwise(F.format_string("[%d..=%d]", "token_start", "token_end"))
    text = F.when(F.col("token_start").isNull(), "").otherwise(F.array_join(F.slice("surfaces", F.col("token_start") + 1, F.col("token_end") - F.col("token_start") + 1), ""))
    attached = F.when(F.col("names").isNull(), "").otherwise(F.concat(F.lit("  ⟨"), "names", F.lit("⟩")))
    more = F.when(F.size("secondary_match_ids") > 0, F.format_string("  (+%d secondary)", F.size("secondary_match_ids"))).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.size("way")), F.rpad("kind", 8, " "), F.lit(" "), span, F.lit(" "), text, attached, more)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("way"))
    return all_.select("doc_id", number.alias("line_number"), line.alias("line"))


def digits(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers.astype(np.int32)).cast(pa.string())


def lists(counts: np.ndarray, values: pa.Array, separator: str) -> pa.Array:
    """Runs of values, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(ragged(counts), values), separator)


def gathered(size: int, at: np.ndarray, values: list[str], separator: str) -> pa.Array:
    """Of each number below size, the values that are at it, joined in their order; empty if none is."""
    found: dict[int, list[str]] = {}
    for k, v in zip(at.tolist(), values):
        found.setdefault(k, []).append(v)
    place = np.zeros(size, np.int32)
    place[np.array(list(found), np.int64)] = np.arange(1, len(found) + 1)
    return pa.array(["", *map(separator.join, found.values())], pa.string()).take(pa.array(place))


def interleaved(rows: list[np.ndarray], values: list[pa.Array]) -> pa.Array:
    """Values at their rows, which are all numbers up to the last."""
    place = np.empty(sum(map(len, rows)), np.int64)
    place[np.concatenate(rows)] = np.arange(len(place))
    return pa.concat_arrays(values).take(pa.array(place))


def outlines(tokens: Tokens, catalog: Compiled) -> DataFrame:
    """outline() of the ranked matches and trees of documents, in a pass: nothing is shuffled or kept."""
    ranker = Ranker(tokens.df.sparkSession, catalog)

    def work(batch):
        found, phrases, r = ranker.find(batch)
        trees, surface = tree.Trees(batch, phrases), batch.strings("surface")
        primary, second = r.shown()
        names = [ranker.rule_names[v] for v in found.vid[r.best[primary]].tolist()]
        told = gathered(len(trees.level), trees.around(r.start[primary], r.end[primary]), names, ", ")
        more = np.bincount(trees.around(r.start[second], r.end[second]), minlength=len(trees.level))
        rows, lines = [np.flatnonzero(trees.level == level) for level in range(len(tree.KINDS))], []
        for level, at in enumerate(rows):
            parts = ["  " * level + tree.KINDS[level].ljust(8) + " [", digits(trees.position[at]), "..=", digits(trees.last[at]), "] "]
            if level == tree.TOKEN:
                parts.append(surface)
            else:
                names, n = told.take(pa.array(at)), more[at]
                parts.append(lists(trees.end[at] - trees.start[at] + 1, surface, ""))
                parts.append(pc.if_else(pc.equal(names, ""), "", pc.binary_join_element_wise("  ⟨", names, "⟩", "")))
                parts.append(pc.if_else(pa.array(n == 0), "", pc.binary_join_element_wise("  (+", digits(n), " secondary)", "")))
            lines.append(pc.binary_join_element_wise(*parts, ""))
        number = np.arange(len(trees.level)) - trees.root[trees.doc] + 1
        return [batch.ids.take(pa.array(trees.doc)), pa.array(number.astype(np.int32)), interleaved(rows, lines)]

    def bare(batch):
        n = len(batch.bare)
        return [batch.bare, pa.array(np.ones(n, np.int32)), pa.array(["document [--] "] * n, pa.string())]

    return tokens.run(work, "line_number int, line string", ["surface", *ranker.needs], bare=bare).filter("doc_id IS NOT NULL")


def token_owners(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, position, owner): the first match in rank order that covers a token, or root."""
    covered = matches.select("doc_id", "id", "rank", F.explode(F.sequence("token_start", "token_end")).alias("position"))
    first = covered.groupBy("doc_id", "position").agg(F.min_by("id", "rank").alias("owner"))
    return tokens.select("doc_id", "position").join(first, ["doc_id", "position"], "left").select("doc_id", "position", F.coalesce("owner", F.lit("root")).alias("owner"))


def dot_lines(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, part, line): statements of a Graphviz graph: root, matches, tokens and their edges."""
    own = token_owners(tokens, matches).join(tokens.select("doc_id", "position", "surface", "pos1"), ["doc_id", "position"])
    root = tokens.select("doc_id").distinct().select("doc_id", F.lit(0).alias("part"), F.lit('  "root" [shape=box, label="sentence"];').alias("line"))
    boxes = matches.select("doc_id", F.lit(1).alias("part"), F.format_string('  "%s" [shape=box, label="%s"];', "id", dot_escape(F.col("rule_name"))).alias("line"))
    to_root = matches.select("doc_id", F.lit(2).alias("part"), F.format_string('  "root" -> "%s";', "id").alias("line"))
    leaf = own.select("doc_id", F.lit(3).alias("part"), F.format_string('  "token-%d" [style=filled, fillcolor="%s", label="%s"];', "position", P.pos_color(F.col("pos1")), dot_escape(F.col("surface"))).alias("line"))
    edge = own.select("doc_id", F.lit(4).alias("part"), F.format_string('  "%s" -> "token-%d";', "owner", "position").alias("line"))
    return root.unionByName(boxes).unionByName(to_root).unionByName(leaf).unionByName(edge)


def dot(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, dot): one Graphviz graph for each document."""
    body = _joined(dot_lines(tokens, matches).withColumn("o", F.struct("part", "line")), ["doc_id"], "o", F.col("line"), "\n", "body")
    return body.select("doc_id", F.concat(F.lit("digraph analysis {\n"), "body", F.lit("\n}")).alias("dot"))


def graph_columns(tokens: DataFrame) -> DataFrame:
    """(doc_id, position, column, width): where a token begins on a terminal line; wide characters count twice."""
    by = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    wide = tokens.withColumn("width", display_width(F.col("surface")).cast("int"))
    return wide.select("doc_id", "position", (F.coalesce(F.sum(F.col("width") + 1).over(by), F.lit(0))).cast("int").alias("column"), "width")


def status_lines(tokens: DataFrame, primary: DataFrame) -> DataFrame:
    """(doc_id, line): how many tokens and matches a document has."""
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("t")).join(primary.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id", "left")
    return n.select("doc_id", F.format_string("%d tokens, %d matches", "t", F.coalesce("m", F.lit(0))).alias("line"))
