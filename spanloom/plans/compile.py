"""Compilation of formation entries to rules, as a plan over tables.

Entries (rule_id, title, formation) become branches and nodes in one narrow map (sources/notation.py). Literals are
tokenised once each; their tokens become steps by a join with the families of closed-class words; hosts become
predicates, alternatives or gaps. Steps are collected into variants, and equal variants of a rule are one.

A catalog is small beside any corpus, but nothing here depends on that until to_rules() collects it.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators.tokens import latin_features, tokenize
from ..sources.catalog import FIELDS, CatalogError, Rule, Step, Variant, parse_toml, render_toml
from ..sources.notation import Hosts, NotationError, branches, plain_title, topology

PRED = f"struct<{','.join(f'{f}:string' for f in FIELDS)}>"
STEP = f"struct<{','.join(f'{f}:string' for f in FIELDS)},wildcard:struct<min:int,max:int>,one_of:array<{PRED}>,optional:boolean,capture:string>"
NODE = f"rule_id string, source string, branch int, branch_text string, node int, kind string, text string, optional boolean, predicates array<{PRED}>, wildcard struct<min:int,max:int>, error string"
#: The widest gap that a host between literals may stand for.
WIDEST = 24


# --------------------------------------------------------------------------------------- notation


def nodes(entries: DataFrame, hosts: Hosts) -> DataFrame:
    """The nodes of all branches of all entries (see NODE); a branch that can't be read is one row with its error."""
    import pyarrow as pa

    kept = entries.select("rule_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("formation", F.lit("")).alias("formation"))
    names = [c.split(" ")[0] for c in NODE.split(", ")]

    def rows_of(rule_id: str, source: str, text: str):
        for k, branch in enumerate(branches(text, hosts), start=1):
            try:
                found = topology(branch, hosts)
            except NotationError as e:
                yield rule_id, source, k, branch, None, None, None, None, None, None, str(e)
                continue
            for n, x in enumerate(found):
                preds = list(dict.fromkeys(p for h in x.hosts for p in h.predicates))
                gap = next((h.wildcard for h in x.hosts if h.wildcard), None)
                yield rule_id, source, k, branch, n, x.kind, x.text, x.optional, [dict(p) for p in preds], {"min": gap[0], "max": gap[1]} if gap else None, None

    pred = pa.struct([(f, pa.string()) for f in FIELDS])
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pred), pa.struct([("min", pa.int32()), ("max", pa.int32())]), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [r for e in batch.to_pylist() for source, text in (("formation", e["formation"]), ("title", plain_title(e["title"]))) for r in rows_of(e["rule_id"], source, text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    return kept.mapInArrow(run, NODE)


def fragments(found: DataFrame) -> DataFrame:
    """(text): each literal once, to be tokenised in one go."""
    return found.filter("kind = 'literal'").select("text").distinct()


# --------------------------------------------------------------------------------------- families


def widened(members: DataFrame, registers: list[str]) -> DataFrame:
    """(pos1, base_form, one_of): what a closed-class word stands for: the members of its family in the given registers,
    in their order, and the word itself.

    members: (family, ord, pos1, base_form, register).
    """
    pred = F.struct(*[F.col(f).alias(f) if f in ("pos1", "base_form") else F.lit(None).cast("string").alias(f) for f in FIELDS])
    usual = members.filter(F.col("register").isin(registers)).groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", pred.alias("p")))), lambda x: x["p"]).alias("usual"))
    every = members.join(usual, "family", "left")
    return every.select("pos1", "base_form", F.array_union(F.coalesce("usual", F.array().cast(f"array<{PRED}>")), F.array(pred)).alias("one_of"))


def inventory_audit(inventory: DataFrame, members: DataFrame) -> DataFrame:
    """(pos1, base_form, problem): members of the inventory in no family, of families that the inventory lacks, and of
    several families. None in a sound registry."""
    key = ["pos1", "base_form"]
    known, listed = inventory.select(*key).distinct(), members.select(*key).distinct()
    out = known.join(listed, key, "left_anti").withColumn("problem", F.lit("in no family"))
    out = out.unionByName(listed.join(known, key, "left_anti").withColumn("problem", F.lit("not in the inventory")))
    return out.unionByName(members.groupBy(*key).agg(F.countDistinct("family").alias("n")).filter("n > 1").select(*key, F.lit("in several families").alias("problem")))


def unknown_class_leaks(unknown: DataFrame) -> DataFrame:
    """(pos1): closed classes that unknown words may get, so that a lexicon would be no full census of them."""
    return unknown.select("pos1").intersect(unknown.sparkSession.createDataFrame([(p,) for p in P.CLOSED_CLASSES], "pos1 string"))


# --------------------------------------------------------------------------------------- steps and variants


def _step(**given: Column) -> Column:
    kinds = dict.fromkeys(FIELDS, "string") | {"wildcard": "struct<min:int,max:int>", "one_of": f"array<{PRED}>", "optional": "boolean", "capture": "string"}
    return F.struct(*[given.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()])


def literal_steps(tokens: DataFrame, wide: DataFrame) -> DataFrame:
    """(text, position, step): closed-class words as their families, verbs and adjectives by lemma, others by surface.

    tokens: token rows whose doc_id is the literal; wide: from widened().
    """
    met = tokens.withColumnRenamed("doc_id", "text").join(F.broadcast(wide), ["pos1", "base_form"], "left")  # a registry
    lemma = F.col("pos1").isin(P.VERB, P.ADJECTIVE) & ~F.col("base_form").isin("", "*")
    step = F.when(F.col("one_of").isNotNull(), _step(one_of=F.col("one_of"))).when(lemma, _step(pos1=F.col("pos1"), base_form=F.col("base_form"))).otherwise(_step(surface=F.col("surface")))
    return met.select("text", "position", step.alias("step"))


def host_steps(found: DataFrame, widest: int = WIDEST) -> DataFrame:
    """found with `side` (left, core, right) and, for hosts, their step.

    Between literals a host is a captured gap of one token and more; at the edges it is its predicate, its predicates as
    alternatives, or its gap, no wider than `widest`.
    """
    branch = Window.partitionBy("rule_id", "source", "branch")
    literal = F.when(F.col("kind") == "literal", F.col("node"))
    placed = found.withColumns({"first": F.min(literal).over(branch), "last": F.max(literal).over(branch)}).filter("first is not null")
    side = F.when(F.col("node") < F.col("first"), "left").when(F.col("node") > F.col("last"), "right").otherwise("core")
    placed = placed.withColumn("side", side)
    slot = F.sum(F.when((F.col("kind") == "host") & (F.col("side") == "core"), 1).otherwise(0)).over(branch.orderBy("node"))
    bounds = lambda low, high: F.struct(low.cast("int").alias("min"), high.cast("int").alias("max"))
    one = F.element_at("predicates", 1)
    step = (
        F.when(F.col("kind") != "host", None)
        .when(F.col("side") == "core", _step(wildcard=bounds(F.lit(1), F.lit(widest)), capture=F.format_string("slot_%d", slot)))
        .when(F.col("wildcard").isNotNull(), _step(wildcard=bounds(F.col("wildcard.min"), F.least(F.col("wildcard.max"), F.lit(widest)))))
        .when(F.size("predicates") == 1, _step(**{f: one[f] for f in FIELDS}))
        .otherwise(_step(one_of=F.col("predicates")))
    )
    return placed.withColumn("step", step)


def variants(found: DataFrame, tokens: DataFrame, wide: DataFrame, widest: int = WIDEST) -> DataFrame:
    """(rule_id, variant_id, left_context, core, right_context): distinct variants in their order.

    Variants come from a rule's formation; only where it yields none, from its title.
    """
    placed = host_steps(found, widest)
    own = placed.filter("kind = 'host'").select("rule_id", "source", "branch", "side", "node", F.lit(0).alias("position"), "step")
    told = placed.filter("kind = 'literal'").drop("step").join(literal_steps(tokens, wide), "text")
    step = F.when(F.col("optional"), F.col("step").withField("optional", F.lit(True))).otherwise(F.col("step"))
    steps = own.unionByName(told.select("rule_id", "source", "branch", "side", "node", "position", step.alias("step")))
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("node", "position", "step")))), lambda x: x["step"]).alias({"core": "core"}.get(side, f"{side}_context"))
    made = steps.groupBy("rule_id", "source", "branch").agg(*map(listed, ("left", "core", "right"))).filter(F.size("core") > 0)
    formed = F.max(F.col("source") == "formation").over(Window.partitionBy("rule_id"))
    made = made.withColumn("formed", formed).filter(~F.col("formed") | (F.col("source") == "formation"))
    return distinct_variants(made).select("rule_id", F.format_string("%s-%02d", "source", "branch").alias("variant_id"), "left_context", "core", "right_context")


def distinct_variants(made: DataFrame, order: str = "branch") -> DataFrame:
    """The first of a rule's variants with equal contexts and core."""
    same = F.to_json(F.struct("left_context", "core", "right_context"))
    by = Window.partitionBy("rule_id", "__same").orderBy(order)
    return made.withColumn("__same", same).withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__same", "__n")


def compile_entries(entries: DataFrame, hosts: Hosts, members: DataFrame, registers: list[str], features: Callable = latin_features, widest: int = WIDEST) -> DataFrame:
    """Variants of all entries; an unreadable branch of a formation is an error."""
    from ..operators.reuse import shared

    found = shared(nodes(entries, hosts))
    bad = found.filter("error is not null and source = 'formation'").select("rule_id", "error").take(1)
    if bad:
        raise NotationError(f"{bad[0]['rule_id']}: {bad[0]['error']}")
    found = found.filter("error is null")
    return variants(found, tokenize(fragments(found), "text", "text", features), widened(members, registers), widest)


def to_rules(entries: DataFrame, made: DataFrame, source: tuple[str, str] = ("", "")) -> list[Rule]:
    """Rules on the driver, in the order of their ids: entries have rule_id, title, formation, jlpt, short_explanation."""

    def step(r) -> Step:
        plain = lambda x: {f: x[f] for f in FIELDS if x[f] is not None}
        return Step(plain(r), [plain(o) for o in r["one_of"] or []], (r["wildcard"]["min"], r["wildcard"]["max"]) if r["wildcard"] else None, bool(r["optional"]), r["capture"])

    listed = made.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("variant_id", "left_context", "core", "right_context")), lambda a, b: F.when(a["variant_id"] < b["variant_id"], -1).when(a["variant_id"] > b["variant_id"], 1).otherwise(0)).alias("variants"))
    out = []
    for r in entries.join(listed, "rule_id", "left").orderBy("rule_id").collect():
        if not r["variants"]:
            raise CatalogError(f"rule {r['rule_id']} has no literal to hold on to")
        made_ = [Variant(v["variant_id"], [step(s) for s in v["core"]], [step(s) for s in v["left_context"]], [step(s) for s in v["right_context"]], priority=0, sense_id=r["rule_id"]) for v in r["variants"]]
        out.append(Rule(r["rule_id"], plain_title(r["title"] or ""), r["jlpt"] or "", r["short_explanation"] or "", f"Formation: {r['formation'] or ''}", [], made_, sense_id=r["rule_id"], source=source))
    return out


# --------------------------------------------------------------------------------------- imports


def flatten_points(raw: DataFrame) -> DataFrame:
    """(source_id, title, level, meaning_en, form_id, text): the forms of raw records: the lines of their casual and polite
    structures, else their title; records without any go.

    raw: (id, title, level, meaning, nuance_translation, casual_structure, polite_structure).
    """
    title = T.plain_text(F.col("title"))
    forms = lambda name: F.transform(T.structure_lines(F.col(f"{name}_structure")), lambda x, i: F.struct(F.format_string(f"{name}-%02d", i + 1).alias("form_id"), x.alias("text")))
    empty = F.array().cast("array<struct<form_id:string,text:string>>")
    lines = F.concat(F.coalesce(forms("casual"), empty), F.coalesce(forms("polite"), empty))
    named = F.when(F.coalesce(title, F.lit("")) == "", empty).otherwise(F.array(F.struct(F.lit("title").alias("form_id"), title.alias("text"))))
    meaning = F.coalesce(T.plain_text(F.when(F.col("meaning") != "", F.col("meaning")).otherwise(F.col("nuance_translation"))), F.lit(""))
    points = raw.select(F.col("id").cast("string").alias("source_id"), F.coalesce(title, F.lit("")).alias("title"), T.level(F.coalesce(F.col("level").cast("string"), F.lit(""))).alias("level"), meaning.alias("meaning_en"), F.when(F.size(lines) > 0, lines).otherwise(named).alias("forms"))
    return points.select("source_id", "title", "level", "meaning_en", F.posexplode("forms").alias("form_no", "f")).select("source_id", "title", "level", "meaning_en", "form_no", "f.form_id", "f.text")


def merge_enrichments(points: DataFrame, enrichments: DataFrame) -> DataFrame:
    """points (from flatten_points) with the forms of enrichments (title, forms), which follow a point's own ones.

    A title that no point has, a title twice, a form without id or text, or a form id twice is an error.
    """
    extra = enrichments.select("title", F.posexplode_outer("forms").alias("k", "f")).select("title", "k", "f.id", "f.text")
    problems = [
        (enrichments.groupBy("title").count().filter("count > 1"), "is enriched twice"),
        (enrichments.join(points.select("title").distinct(), "title", "left_anti"), "is no known title"),
        (extra.filter("coalesce(id, '') = '' or coalesce(text, '') = ''"), "has a form without id or text"),
        (extra.groupBy("title", "id").count().filter("count > 1"), "has a form id twice"),
    ]
    for rows, what in problems:
        if bad := rows.select("title").take(1):
            raise CatalogError(f"{bad[0]['title']} {what}")
    heads = points.groupBy("title").agg(F.max(F.struct("form_no", "source_id", "level", "meaning_en")).alias("h"))
    more = extra.join(heads, "title").select(F.col("h.source_id").alias("source_id"), "title", F.col("h.level").alias("level"), F.col("h.meaning_en").alias("meaning_en"), (F.col("h.form_no") + 1 + F.col("k")).alias("form_no"), F.concat(F.lit("enrichment-"), "id").alias("form_id"), "text")
    return points.unionByName(more)


# --------------------------------------------------------------------------------------- writers


def manifest_examples(entries: DataFrame) -> DataFrame:
    """One row for each example of an entry: entries have rule_id, jlpt, file, source_index, title, formation, examples."""
    one = entries.select("rule_id", "jlpt", "file", "source_index", "title", "formation", F.posexplode("examples").alias("k", "x"))
    return one.select(F.col("rule_id").alias("owning_rule_id"), "jlpt", F.col("file").alias("source_file"), "source_index", (F.col("k") + 1).alias("example_index"), "title", F.coalesce("formation", F.lit("")).alias("formation"), *[F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in ("jp", "romaji", "en")])


def manifest_files(entries: DataFrame, digests: DataFrame) -> DataFrame:
    """(file, jlpt, sha256, entries, examples) of each source file; digests has file and sha256."""
    counted = entries.groupBy("file", "jlpt").agg(F.count("*").alias("entries"), F.sum(F.coalesce(F.size("examples"), F.lit(0))).cast("long").alias("examples"))
    return counted.join(digests.select("file", "sha256"), "file").select("file", "jlpt", "sha256", "entries", "examples")


def aggregate_digest(files: DataFrame) -> DataFrame:
    """(aggregate_sha256, logical_rules): over the names and digests of all files in the order of their names."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("file", "sha256"))), lambda x: F.concat(x["file"], x["sha256"]))
    return files.agg(T.sha256(F.array_join(listed, "")).alias("aggregate_sha256"), F.coalesce(F.sum("entries"), F.lit(0)).alias("logical_rules"))


def manifest_json(entries: DataFrame, digests: DataFrame) -> DataFrame:
    """(json): the regression manifest as one document."""
    files = manifest_files(entries, digests)
    examples = manifest_examples(entries).agg(F.array_sort(F.collect_list(F.struct("source_file", "source_index", "example_index", "owning_rule_id", "jlpt", "title", "formation", "jp", "romaji", "en"))).alias("examples"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct(F.col("file").alias("name"), "jlpt", "sha256", "entries", "examples"))).alias("files"))
    whole = aggregate_digest(files).join(F.broadcast(listed)).join(F.broadcast(examples))  # one row each
    source = F.struct("aggregate_sha256", "files")
    return whole.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), source.alias("source"), "logical_rules", "examples")).alias("json"))


def replace_folder(target: str | Path, files: dict[str, str]) -> None:
    """Write files to a folder that takes the place of `target` as a whole; on failure the old folder is there again."""
    target = Path(target).absolute()
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{target.name}-new-", dir=target.parent))
    old = target.with_name(f".{target.name}-old")
    try:
        for name, text in files.items():
            (stage / name).write_text(text, "utf-8")
        shutil.rmtree(old, ignore_errors=True)
        if target.exists():
            target.rename(old)
        stage.rename(target)
    except BaseException:
        if old.exists() and not target.exists():
            old.rename(target)
        raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    shutil.rmtree(old, ignore_errors=True)


def write_catalog(target: str | Path, rules: list[Rule], manifest: str | None = None) -> dict[str, int]:
    """Write rules to one TOML file for each level, and the manifest; what is written is read back before it counts.

    Returns the number of rules of each level.
    """
    levels: dict[str, list[Rule]] = {}
    for r in rules:
        levels.setdefault(r.jlpt or "other", []).append(r)
    files = {f"{k.lower()}.toml": render_toml(some) for k, some in sorted(levels.items())}
    for name, text in files.items():
        parse_toml(text, name)
    replace_folder(target, files | ({"regression.json": manifest} if manifest is not None else {}))
    return {k: len(some) for k, some in sorted(levels.items())}


def level_counts(rules: DataFrame) -> DataFrame:
    """(jlpt, rules, variants): rules has rule_id, jlpt and n_variants."""
    return rules.groupBy("jlpt").agg(F.count("*").alias("rules"), F.sum("n_variants").cast("long").alias("variants"))
