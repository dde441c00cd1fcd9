"""The whole analysis of documents as one lazy plan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from json.encoder import encode_basestring
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gloss as G
from ..operators import match, rank, segment, tree
from ..operators.ordered import Tokens
from ..operators.render import digits, gathered, lists
from ..operators.reuse import shared
from ..operators.tokens import FEATURES, analysed, latin_features, tokenize
from ..sources.catalog import CatalogError, Compiled, Rule, compile_rules, load_combined

SCHEMA_VERSION = 3


@dataclass
class Analysis:
    """The tables of an analysis; nothing is computed before they are used."""

    docs: DataFrame
    tokens: DataFrame
    phrases: DataFrame
    candidates: DataFrame
    primary: DataFrame
    secondary: DataFrame
    glosses: DataFrame | None
    words: DataFrame | None
    nodes: DataFrame
    edges: DataFrame


class Analyzer:
    """A catalog and a dictionary, ready for any number of document tables."""

    def __init__(self, rules: list[Rule] | None = None, local: str | Path | None = None, dictionary: DataFrame | None = None, features=latin_features):
        if rules is not None and local is not None:
            raise CatalogError("either rules or a local folder, not both")
        if local is not None and Path(local).exists() and not Path(local).is_dir():
            raise CatalogError(f"{local} is no folder")
        self.rules = rules if rules is not None else load_combined(local)
        self.catalog: Compiled = compile_rules(self.rules)
        self.dictionary, self.features = dictionary, features

    def of_tokens(self, docs: DataFrame, tokens: DataFrame) -> Analysis:
        """Analysis of given token rows; docs has doc_id and input."""
        phrases = shared(segment.phrases(tokens.repartition("doc_id")))
        tokens = phrases.select(*tokens.columns)
        found = match.candidates(phrases, self.catalog)
        primary, secondary = rank.rank(found, phrases)
        glosses, words = G.gloss(phrases, self.dictionary) if self.dictionary is not None else (None, None)
        secondary = shared(secondary)
        nodes, edges = tree.build(docs, phrases, words)
        nodes = shared(tree.attach(shared(nodes), primary, secondary, phrases))
        return Analysis(docs, tokens, phrases, found, primary, secondary, glosses, words, nodes, shared(edges))

    def analyze(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Analysis:
        docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("input"))
        return self.of_tokens(docs, tokenize(docs, "doc_id", "input", self.features))


def _ordered(df: DataFrame, order: list[str], shape, out: str) -> DataFrame:
    """One list for each document, in the given order."""
    packed = df.select("doc_id", F.struct(*order, shape.alias("x")).alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return packed.select("doc_id", F.transform("l", lambda s: s["x"]).alias(out))


DISPLAY = ("id", "rule_name", "jlpt", "meaning_en", "hint", "sense_id", "ambiguity_group", "captures", "token_start", "token_end", "score", "provenance")


def documents(a: Analysis) -> DataFrame:
    """(doc_id, document): one struct for each document, with tokens, matches and tree; see document_json()."""
    tokens = analysed(a.tokens)
    sense = "array<struct<entry_seq:bigint,gloss:string,pos:array<string>>>"
    if a.glosses is not None:
        listed = a.glosses.groupBy("doc_id", "position").agg(F.array_sort(F.collect_list(F.struct("n", "entry_seq", "gloss", "pos"))).alias("l"))
        listed = listed.select("doc_id", "position", F.transform("l", lambda s: F.struct(s["entry_seq"].alias("entry_seq"), s["gloss"].alias("gloss"), s["pos"].alias("pos"))).alias("glosses"))
        tokens = tokens.join(listed, ["doc_id", "position"], "left")
    else:
        tokens = tokens.withColumn("glosses", F.lit(None).cast(sense))
    glosses = F.coalesce(F.col("glosses"), F.array().cast(sense)).alias("glosses")
    token = F.struct("id", "surface", *FEATURES, "byte_start", "byte_end", "position", glosses)
    second = F.struct(F.col("secondary_id").alias("id"), F.struct(*DISPLAY).alias("matched"), "reason", "blocked_by")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("document", 0), ("sentence", 1), ("bunsetsu", 2), ("word", 3), ("token", 3)) for x in p]), F.col("kind"))
    node = F.struct("id", "kind", "token_start", "token_end", "token_id", "match_ids", "secondary_match_ids")
    edge = F.struct("parent_id", "child_id", "order")
    nodes = a.nodes.withColumns({"__from": F.coalesce("token_start", F.lit(-1)), "__kind": kind})
    out = a.docs.select("doc_id", "input")
    parts = [
        (_ordered(tokens, ["position"], token, "tokens"), "tokens"),
        (_ordered(a.primary.withColumn("__id", F.col("id")), ["token_start", "token_end", "__id"], F.struct(*DISPLAY), "primary_matches"), "primary_matches"),
        (_ordered(a.secondary.withColumn("__id", F.col("id")), ["token_start", "token_end", "__id"], second, "secondary_matches"), "secondary_matches"),
        (_ordered(nodes, ["__from", "__kind"], node, "nodes"), "nodes"),
        (_ordered(a.edges.withColumn("__p", F.col("parent_id")), ["__p", "order"], edge.alias("e"), "edges"), "edges"),
    ]
    for part, name in parts:
        kind_of = dict(part.dtypes)[name]
        out = out.join(part, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind_of)))
    whole = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "input", "tokens", "primary_matches", "secondary_matches", F.struct(F.lit("document-0").alias("root_id"), "nodes", "edges").alias("tree"))
    return out.select("doc_id", whole.alias("document"))


def document_json(a: Analysis, pretty: bool = False) -> DataFrame:
    """(doc_id, json): missing values are written as null."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return documents(a).select("doc_id", F.to_json("document", options).alias("json"))


# ---------------------------------------------------------------------------------------------------
# The same in a pass over whole documents

#: Tokens of a batch: each makes about 500 bytes of JSON.
JSON_ROWS = 1 << 14
#: Control characters whose numbers have letters.
_CONTROL = re.compile("([\x0b\x0e\x0f\x1a-\x1f])")


def quoted(text: str | None) -> str:
    """A JSON string as to_json() writes it: control characters with capital digits, all others as they are."""
    if text is None:
        return "null"
    if _CONTROL.search(text) is None:
        return encode_basestring(text)
    return '"' + "".join(f"\\u{ord(x):04X}" if i % 2 else encode_basestring(x)[1:-1] for i, x in enumerate(_CONTROL.split(text))) + '"'


def _string_order(numbers: np.ndarray) -> np.ndarray:
    """The place of each number in the order of numbers as strings."""
    order = sorted(range(int(numbers.max(initial=0)) + 1), key=str)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[numbers]


class _Shown:
    """JSON of ranked matches; what depends on the variant only is made once, by Spark."""

    def __init__(self, ranker: rank.Ranker, catalog: Compiled, spark: SparkSession):
        options = {"ignoreNullFields": "false"}
        told = lambda c: F.to_json(F.struct(*c), options)
        parts = {
            "names": ("rule_name", "jlpt", "meaning_en", "hint", "sense_id", "ambiguity_group"),
            "score": ("fallback", "priority"),
            "steps": ("wildcard_steps", "optional_steps"),
            "source": (F.struct(F.col("source_id").alias("id"), F.col("source_label").alias("label")).alias("source"), "rule_id", "variant_id"),
        }
        rows = sorted(catalog.table(spark, "variants").select("vid", *[told(c).alias(n) for n, c in parts.items()]).collect(), key=lambda r: r["vid"])
        self.names, self.score, self.steps = ([r[n][1:-1] for r in rows] for n in ("names", "score", "steps"))
        self.sources = [r["source"] for r in rows]
        self.captures = [quoted(n) for n in ranker.matcher.names]

    def lines(self, found: match.Found, r: rank.Ranked, base: np.ndarray) -> list[str]:
        """Of each match, strongest first; base has the first place of its document."""
        best = r.best
        start, end = r.start - base, r.end - base
        captured = [""] * len(best)
        caps = found.caps[best]
        for i, k in zip(*(x.tolist() for x in np.nonzero(caps[:, :, 0] >= 0))):
            name, s, e = caps[i, k].tolist()
            one = f'{{"name":{self.captures[name]},"token_start":{s - base[i]},"token_end":{e - base[i]}}}'
            captured[i] = f"{captured[i]},{one}" if captured[i] else one
        vids, counts = r.provenance
        sources, to = [self.sources[v] for v in vids.tolist()], np.cumsum(counts)
        rows = zip(rank.match_ids(start, end, r.n), found.vid[best].tolist(), captured, start.tolist(), end.tolist(), found.core[best].tolist(), found.context[best].tolist(), (to - counts).tolist(), to.tolist())
        return [
            f'{{"id":"{id_}",{self.names[v]},"captures":[{caps}],"token_start":{s},"token_end":{e},"score":{{{self.score[v]},"span_length":{e - s + 1},'
            f'"core_specificity":{core},"context_specificity":{context},{self.steps[v]}}},"provenance":[{",".join(sources[i:j])}]}}'
            for id_, v, caps, s, e, core, context, i, j in rows
        ]


def texts_json(docs: DataFrame, catalog: Compiled, key: str = "doc_id", text: str = "text") -> DataFrame:
    """document_json() of the analysis of Latin-script texts without a dictionary, in a pass: nothing is shuffled or kept."""
    spark = docs.sparkSession
    ranker = rank.Ranker(spark, catalog)
    shown = _Shown(ranker, catalog, spark)
    join = lambda *parts: pc.binary_join_element_wise(*parts, "")
    begin, nothing = f'{{"schema_version":{SCHEMA_VERSION},"input":', '],"edges":[]}}'

    def tokens_of(batch, position) -> pa.Array:
        words, base = batch.words, batch.distinct("base_form")
        plain = lambda of: pa.array([quoted(w)[1:-1] if len(w) == 1 else w for w in of], pa.string())  # noqa: E731  longer ones are letters or digits
        head = pa.array([",".join(f'"{f}":{quoted(k[f])}' for f in FEATURES[:-2]) for k in batch.kinds], pa.string())
        tail = pa.array([f'"{FEATURES[-1]}":{quoted(k[FEATURES[-1]])}' for k in batch.kinds], pa.string())
        kind, at = pa.array(batch.kind_of), pa.array(batch.indices)
        word = join('"surface":"', plain(words), '",', head.take(kind), f',"{FEATURES[-2]}":"', plain(base), '",', tail.take(kind))
        whole = np.cumsum(batch.octets, dtype=np.int64)
        first = batch.places.first_row
        whole -= np.repeat((whole - batch.octets)[first], np.diff(np.append(first, len(whole))))
        size = pc.binary_length(batch.surface.dictionary).to_numpy(zero_copy_only=False)[batch.indices]
        return join('{"id":"token-', position, '",', word.take(at), ',"byte_start":', digits(whole - size), ',"byte_end":', digits(whole), ',"position":', position, ',"glosses":[]}')

    def matches_of(batch, trees, found, r):
        """Primary and secondary matches of documents, and of nodes their ids."""
        n, nodes = len(batch.ids), len(trees.level)
        base = batch.places.base[r.doc]
        ids, lines = rank.match_ids(r.start - base, r.end - base, r.n), shown.lines(found, r, base)
        primary, second = r.shown()
        around = [trees.around(r.start[x], r.end[x]) for x in (primary, second)]
        contains = (r.start[r.by] <= r.start) & (r.end[r.by] >= r.end)
        told, others = [], []
        rows = (x[second].tolist() for x in (np.arange(len(ids)), r.start - base, r.end - base, r.among, r.by, contains))
        for i, s, e, k, by, inside in zip(*rows):
            others.append(f'"secondary-{s}-{e}-{k}"')
            told.append(f'{{"id":{others[-1]},"matched":{lines[i]},"reason":"{rank.CONTAINED if inside else rank.OVERLAPS}","blocked_by":"{ids[by]}"}}')
        first = primary.tolist()
        of = [lists(np.bincount(r.doc[x], minlength=n), pa.array(y, pa.string()), ",") for x, y in ((primary, [lines[i] for i in first]), (second, told))]
        return *of, gathered(nodes, around[0], [f'"{ids[i]}"' for i in first], ","), gathered(nodes, around[1], others, ",")

    def tree_of(batch, trees, position, primary, second):
        """Nodes and edges of documents."""
        n, per_token = len(batch.ids), trees.places.rows
        documents, sentences, phrases, tokens = rows = [np.flatnonzero(trees.level == level) for level in range(len(tree.KINDS))]
        take = lambda x, at: x.take(pa.array(at))
        of_sentence = lambda at: join("sentence-", digits(trees.sentence[at]))
        ids = [pa.array(["document-0"] * n, pa.string()), of_sentence(sentences), join("bunsetsu-", digits(trees.sentence[phrases]), "-", digits(trees.number[phrases]))]
        # What opens at a token stands before the token's own node.
        opened = pa.array([""] * per_token, pa.string())
        for kind, at, id_ in zip(tree.KINDS, rows, ids):
            spans = (digits(trees.position[at]), ',"token_end":', digits(trees.last[at]))
            made = join('{"id":"', id_, f'","kind":"{kind}","token_start":', *spans, ',"token_id":null,"match_ids":[', take(primary, at), '],"secondary_match_ids":[', take(second, at), "]},")
            place = np.zeros(per_token, np.int64)
            place[np.searchsorted(trees.places.at, trees.start[at])] = np.arange(1, len(at) + 1)
            opened = join(opened, take(pa.concat_arrays([pa.array([""], pa.string()), made]), place))
        nodes = join(opened, '{"id":"token-', position, '","kind":"token","token_start":', position, ',"token_end":', position, ',"token_id":"token-', position, '","match_ids":[],"secondary_match_ids":[]}')
        # Edges follow their parents' ids as strings: those of phrases, of documents, of sentences.
        edge = lambda parent, child, order: join('{"parent_id":"', parent, '","child_id":"', child, '","order":', digits(order), "}")
        by_sentence, by_number = _string_order(trees.sentence), _string_order(trees.number)
        order = trees.start[tokens] - trees.phrases.start[trees.start[tokens]]
        sort = np.lexsort([order, by_number[tokens], by_sentence[tokens], trees.doc[tokens]])
        phrase = (np.cumsum(trees.level == tree.PHRASE) - 1)[tokens[sort]]
        of_tokens = edge(take(ids[2], phrase), join("token-", take(position, sort)), order[sort])
        sort = np.lexsort([trees.number[phrases], by_sentence[phrases], trees.doc[phrases]])
        of_phrases = edge(of_sentence(phrases[sort]), take(ids[2], sort), trees.number[phrases[sort]])
        edges = [(tokens, of_tokens), (sentences, edge("document-0", ids[1], trees.sentence[sentences])), (phrases, of_phrases)]
        told = [lists(np.bincount(trees.doc[at], minlength=n), x, ",") for at, x in edges]
        return lists(np.bincount(trees.doc[tokens], minlength=n), nodes, ","), join(told[0], ",", told[1], ",", told[2])

    def inputs(batch, bare: bool) -> pa.Array:
        return pa.array([quoted(x) for x in batch.inputs(bare).to_pylist()], pa.string())

    def empty(text: pa.Array, ids: pa.Array) -> pa.Array:
        """Documents without tokens; what has no id has no root either."""
        root = '{"id":"document-0","kind":"document","token_start":null,"token_end":null,"token_id":null,"match_ids":[],"secondary_match_ids":[]}'
        return join(begin, text, ',"tokens":[],"primary_matches":[],"secondary_matches":[],"tree":{"root_id":"document-0","nodes":[', pc.if_else(ids.is_null(), "", root), nothing)

    def work(batch):
        found, phrases, r = ranker.find(batch)
        trees, places = tree.Trees(batch, phrases), batch.places
        position = digits(places.at - places.base[places.doc(places.at)])
        text, of_docs = inputs(batch, False), np.diff(np.append(places.first_row, places.rows))
        tokens = lists(of_docs, tokens_of(batch, position), ",")
        primary, second, named, others = matches_of(batch, trees, found, r)
        nodes, edges = tree_of(batch, trees, position, named, others)
        out = join(begin, text, ',"tokens":[', tokens, '],"primary_matches":[', primary, '],"secondary_matches":[', second, '],"tree":{"root_id":"document-0","nodes":[', nodes, '],"edges":[', edges, "]}}")
        if batch.ids.null_count:
            out = pc.if_else(batch.ids.is_null(), empty(text, batch.ids), out)
        return [batch.ids, out]

    return Tokens.of_texts(docs, key, text).run(work, "json string", rows=JSON_ROWS, bare=lambda b: [b.bare, empty(inputs(b, True), b.bare)])


def tokens_json(tokens: DataFrame) -> DataFrame:
    """(doc_id, json): the token rows of a document as a list."""
    token = F.struct("surface", *FEATURES, "byte_start", "byte_end", "position")
    return _ordered(tokens, ["position"], token, "l").select("doc_id", F.to_json("l", {"ignoreNullFields": "false"}).alias("json"))


DOCUMENT_CHECKS = ("schema_version", "input", "tokens", "primary_matches", "secondary_matches", "tree")


def parse_documents(df: DataFrame, json: str = "json") -> DataFrame:
    """df with `shape_error`: what a document's JSON lacks at its top, or null."""
    top = F.from_json(json, "map<string,string>")
    missing = F.filter(F.array(*[F.lit(c) for c in DOCUMENT_CHECKS]), lambda c: ~F.map_contains_key(F.col("__top"), c))
    checked = df.withColumn("__top", top)
    error = F.when(F.col("__top").isNull(), "not an object").when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.element_at(missing, 1))).when(F.col("__top")["schema_version"] != str(SCHEMA_VERSION), "another schema version")
    return checked.withColumn("shape_error", error).drop("__top")


def legacy(tokens: DataFrame, catalog: Compiled) -> DataFrame:
    """One reading for each occurrence, without ranking: what the graph outputs draw."""
    return match.resolve(match.candidates(tokens, catalog))


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()
