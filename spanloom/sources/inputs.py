"""Inputs other than rule catalogs: texts, dictionaries, treebanks, registries, manifests, requests."""

from __future__ import annotations

import glob
import io
import json
import sys
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.gloss import ENTRY
from .notation import Host, Hosts


def read_texts(spark: SparkSession, text: str | None = None, path: str | None = None, stdin: str | None = None) -> DataFrame:
    """(doc_id, input) of the first that is given: a text, files read whole, standard input; blank input is no row."""
    if text is not None:
        return spark.createDataFrame([(0, text)], "doc_id long, input string")
    if path is not None:
        files = spark.read.text(path, wholetext=True).select(F.col("value").alias("input"), F.input_file_name().alias("file"))
        names = files.select("file").distinct()  # only names are put in one order, not texts
        numbered = names.select(F.col("file").alias("name"), (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("doc_id"))
        return files.join(numbered, F.col("file") == F.col("name")).select("doc_id", "input")
    piped = stdin if stdin is not None else "" if sys.stdin is None or sys.stdin.isatty() else sys.stdin.read()
    return spark.createDataFrame([(0, piped)] if piped.strip() else [], "doc_id long, input string")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary entries from JSON lines; entry_ord is the order of the file where it is not given."""
    return spark.read.schema(ENTRY).json(path).withColumn("entry_ord", F.coalesce("entry_ord", "entry_seq"))


def read_conllu(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sentences, gold) of CoNLL-U files: (file, sent_id, text) and (file, sent_id, boundary_offset).

    A blank line ends a sentence; comments, ranges and empty nodes are skipped; BunsetuBILabel=B in the last column
    begins a phrase, at offset 0 too, which is no boundary. A file is read as one row, so its lines stay in order.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "row"))
    by = Window.partitionBy("file").orderBy("line")
    lines = lines.withColumn("block", F.sum((F.col("row") == "").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cols = F.split("row", "\t")
    words = lines.filter(~F.col("row").startswith("#") & (F.size(cols) >= 10) & cols[0].rlike("^[0-9]+$"))
    words = words.select("file", "block", "line", cols[1].alias("surface"), F.array_contains(F.split(cols[9], "\\|"), "BunsetuBILabel=B").alias("begins"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    laid = words.withColumn("boundary_offset", F.coalesce(F.sum(F.char_length("surface")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    texts = words.groupBy("file", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "surface"))), lambda x: x["surface"]), "").alias("text")).filter("text <> ''")
    numbered = texts.withColumn("sent_id", (F.row_number().over(Window.partitionBy("file").orderBy("block")) - 1).cast("long"))
    gold = laid.filter(F.col("begins") & (F.col("boundary_offset") > 0)).join(numbered.select("file", "block", "sent_id"), ["file", "block"])
    return numbered.select("file", "sent_id", "text"), gold.select("file", "sent_id", "boundary_offset")


def read_grammar_shards(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON shards named ..._N1_....json to N5, with their level; a level in two shards is an error."""
    entry = "title string, short_explanation string, formation string, examples array<struct<jp:string,romaji:string,en:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in entry.split(', '))}>>").alias("all"))
    leveled = raw.withColumn("jlpt", F.regexp_extract("file", "_N([1-5])_", 1)).filter("jlpt <> ''").withColumn("jlpt", F.concat(F.lit("N"), "jlpt"))
    twice = [r["jlpt"] for r in leveled.groupBy("jlpt").count().filter("count > 1").collect()]
    if twice:
        raise ValueError(f"more than one shard for {sorted(twice)}")
    return leveled.select("jlpt", "file", F.posexplode("all").alias("source_index", "e")).select("jlpt", "file", "source_index", "e.*")


def find_record_lists(value) -> list[list[dict]]:
    """All lists of objects with id and title, anywhere in parsed JSON."""
    out = []
    if isinstance(value, list):
        if value and all(isinstance(x, dict) and "id" in x and "title" in x for x in value):
            out.append(value)
        for x in value:
            out += find_record_lists(x)
    elif isinstance(value, dict):
        for x in value.values():
            out += find_record_lists(x)
    return out


def read_snapshot(text: str, schema: str) -> list[dict]:
    """Grammar points of a snapshot: those it declares under its schema, else its longest list of records."""
    raw = json.loads(text)
    if isinstance(raw, dict) and raw.get("schema") == schema:
        return raw["grammar_points"]
    lists = find_record_lists(raw)
    if not lists:
        raise ValueError("no list of records with id and title")
    return max(lists, key=len)


ENRICHMENTS = "schema string, rules array<struct<title:string,forms:array<struct<id:string,text:string>>>>"
HOSTS = "hosts array<struct<name:string,aliases:array<string>,predicates:array<struct<surface:string,pos1:string,pos2:string,conj_form:string,base_form:string>>,wildcard:struct<min:int,max:int>>>"
FAMILIES = "families array<struct<name:string,description:string,members:array<struct<pos1:string,base_form:string,register:string>>>>"
MANIFEST = "logical_rules int, examples array<struct<owning_rule_id:string,jlpt:string,source_file:string,source_index:int,example_index:int,title:string,formation:string,jp:string,romaji:string,en:string>>"


def read_enrichments(spark: SparkSession, path: str) -> DataFrame:
    """(title, forms) of an enrichment file."""
    return spark.read.schema(ENRICHMENTS).json(path, multiLine=True).select(F.explode("rules").alias("r")).select("r.title", "r.forms")


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """(name, aliases, predicates, wildcard): exactly one of the last two is given, and no alias twice."""
    hosts = spark.read.schema(HOSTS).json(path, multiLine=True).select(F.explode("hosts").alias("h")).select("h.*")
    both = (F.size(F.coalesce("predicates", F.array().cast(hosts.schema["predicates"].dataType))) > 0) == F.col("wildcard").isNotNull()
    if not hosts.filter(both | (F.size("aliases") < 1)).isEmpty():
        raise ValueError("a host needs aliases and either predicates or a wildcard")
    if not hosts.select(F.explode("aliases").alias("a")).groupBy("a").count().filter("count > 1").isEmpty():
        raise ValueError("an alias belongs to two hosts")
    return hosts


def host_registry(hosts: DataFrame) -> Hosts:
    """The rows of read_hosts() as the registry that notation is read with."""
    plain = lambda p: tuple(sorted((k, v) for k, v in p.asDict().items() if v is not None))
    return Hosts([Host(r["name"], tuple(r["aliases"]), tuple(plain(p) for p in r["predicates"] or []), (r["wildcard"]["min"], r["wildcard"]["max"]) if r["wildcard"] else None) for r in hosts.collect()])  # a registry


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(family, ord, pos1, base_form, register): no member in two families."""
    members = spark.read.schema(FAMILIES).json(path, multiLine=True).select(F.explode("families").alias("f")).select(F.col("f.name").alias("family"), F.posexplode("f.members").alias("ord", "m")).select("family", "ord", "m.*")
    if not members.groupBy("pos1", "base_form").count().filter("count > 1").isEmpty():
        raise ValueError("a member belongs to two families")
    return members


def find_archive(pattern: str) -> str:
    """The first file, by name, that matches a pattern."""
    found = sorted(glob.glob(pattern))
    if not found:
        raise FileNotFoundError(f"no file matches {pattern}")
    return found[0]


def read_lexicon(spark: SparkSession, archive: str, member: str = ".csv") -> DataFrame:
    """(pos1, pos2, base_form) of the lexicon files in a tar archive: columns 4, 5 and 11 of their lines.

    The archive is unpacked by the driver, as a dictionary is; its rows are then spread.
    """
    with tarfile.open(archive) as tar:
        texts = [io.TextIOWrapper(tar.extractfile(m), "utf-8").read() for m in tar if m.isfile() and m.name.endswith(member)]
    rows = spark.createDataFrame([(line,) for t in texts for line in t.splitlines() if line], "line string")
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(12)))
    return rows.select(cells.alias("c")).select(F.col("c.c4").alias("pos1"), F.col("c.c5").alias("pos2"), F.col("c.c11").alias("base_form"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a regression manifest with their rules."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("examples").alias("e")).select("e.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, json) of analysis documents, read whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))


def local_folder(path: str | Path) -> Path | None:
    """A folder of local rules: None if it is missing, an error if it is no folder."""
    p = Path(path)
    if not p.exists():
        return None
    if not p.is_dir():
        raise NotADirectoryError(str(p))
    return p
