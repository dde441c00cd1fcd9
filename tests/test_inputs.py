"""Readers of every input, and the renderings that no registered query reaches."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from spanloom import queries as Q
from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.operators import evaluate, render, segment, tree
from spanloom.operators.tokens import tokenize
from spanloom.plans.analyze import Analyzer, legacy, tokens_json
from spanloom.sources import inputs as I
from spanloom.sources.catalog import compile_rules


def test_texts(spark, tmp_path):
    for name, text in (("b.txt", "two\nlines"), ("a.txt", "one")):
        (tmp_path / name).write_text(text)
    assert sorted(tuple(r) for r in I.read_texts(spark, path=str(tmp_path)).collect()) == [(0, "one"), (1, "two\nlines")]
    assert I.read_texts(spark, text="x").collect() == [(0, "x")] and I.read_texts(spark, stdin=" \n").count() == 0
    assert I.read_texts(spark, stdin="y").first().input == "y"


def test_conllu(spark, tmp_path):
    word = lambda i, w, b: "\t".join([str(i), w, *["_"] * 7, f"BunsetuBILabel={b}|x=1"])
    rows = ["# text = ignored", word(1, "東京", "B"), word(2, "で", "I"), word("3-4", "xx", "B"), word(3, "会う", "B"), "", word(1, "はい", "B"), ""]
    (tmp_path / "x.conllu").write_text("\n".join(rows), "utf-8")
    items, gold = I.read_conllu(spark, str(tmp_path / "x.conllu"))
    assert [(r.sent_id, r.text) for r in items.orderBy("sent_id").collect()] == [(0, "東京で会う"), (1, "はい")]
    assert [(r.sent_id, r.boundary_offset) for r in gold.collect()] == [(0, 3)]


def test_json_inputs(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value), "utf-8") and str(tmp_path / name)
    shard = [{"title": "t", "short_explanation": "s", "formation": "f", "examples": [{"jp": "j", "romaji": "r", "en": "e"}]}]
    path = put("grammar_N5_x.json", shard)
    [row] = I.read_grammar_shards(spark, path).collect()
    assert (row.jlpt, row.source_index, row.title, row.examples[0].en) == ("N5", 0, "t", "e")
    put("other_N5_y.json", shard)
    with pytest.raises(ValueError, match="N5"):
        I.read_grammar_shards(spark, str(tmp_path / "*_N5_*.json"))
    assert I.read_snapshot(json.dumps({"schema": "s", "grammar_points": [1]}), "s") == [1]
    assert I.read_snapshot(json.dumps({"a": [{"x": [{"id": 1, "title": "t"}]}, {"id": 3, "title": "z"}]}), "s") == [{"id": 1, "title": "t"}]
    with pytest.raises(ValueError):
        I.read_snapshot("{}", "s")
    [e] = I.read_enrichments(spark, put("e.json", {"schema": "x", "rules": [{"title": "t", "forms": [{"id": "a", "text": "b"}]}]})).collect()
    assert (e.title, e.forms[0].id) == ("t", "a")
    hosts = {"hosts": [{"name": "noun", "aliases": ["noun"], "predicates": [{"pos1": "名詞"}]}, {"name": "gap", "aliases": ["phrase"], "wildcard": {"min": 0, "max": 3}}]}
    registry = I.host_registry(I.read_hosts(spark, put("h.json", hosts)))
    assert [h.name for *_, h in registry.find("noun phrase")] == ["noun", "gap"] and registry.by_alias["phrase"].wildcard == (0, 3)
    with pytest.raises(ValueError):
        I.read_hosts(spark, put("h2.json", {"hosts": [{"name": "a", "aliases": ["x"]}]}))
    member = {"pos1": "助動詞", "base_form": "ない", "register": "standard"}
    families = I.read_families(spark, put("f.json", {"families": [{"name": "negation", "description": "", "members": [member]}]}))
    assert [(r.family, r.ord, r.base_form) for r in families.collect()] == [("negation", 0, "ない")]
    with pytest.raises(ValueError):
        I.read_families(spark, put("f2.json", {"families": [{"name": n, "description": "", "members": [member]} for n in "ab"]}))
    [m] = I.read_manifest(spark, put("m.json", {"logical_rules": 1, "examples": [{"owning_rule_id": "r", "jp": "x"}]})).collect()
    assert (m.owning_rule_id, m.jp) == ("r", "x")
    assert I.read_documents(spark, put("d.json", {"input": "x"})).first().json == '{"input": "x"}'
    (tmp_path / "dict.jsonl").write_text(json.dumps({"entry_seq": 7, "kanji": ["水"], "readings": ["みず"], "senses": [{"glosses": ["water"], "pos": ["Noun"]}]}))
    [entry] = I.read_dictionary(spark, str(tmp_path / "dict.jsonl")).collect()
    assert (entry.entry_ord, entry.senses[0].glosses) == (7, ["water"])


def test_archives_and_folders(spark, tmp_path):
    with tarfile.open(tmp_path / "lex.tar.gz", "w:gz") as tar:
        data = "ない,1,2,3,助動詞,*,*,*,x,y,ナイ,ない\n".encode()
        info = tarfile.TarInfo("a/lex.csv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert [tuple(r) for r in I.read_lexicon(spark, I.find_archive(str(tmp_path / "*.tar.gz"))).collect()] == [("助動詞", "*", "ない")]
    with pytest.raises(FileNotFoundError):
        I.find_archive(str(tmp_path / "none*"))
    assert I.local_folder(tmp_path / "none") is None and I.local_folder(tmp_path) == tmp_path
    with pytest.raises(NotADirectoryError):
        I.local_folder(tmp_path / "lex.tar.gz")


@pytest.fixture(scope="module")
def analysis(spark):
    docs = spark.createDataFrame([(1, "Talk of the town, in Paris."), (2, "")], "doc_id long, text string")
    return Analyzer(Q.latin_rules()).analyze(docs)


def test_renderings(spark, analysis):
    tokens = analysis.tokens
    assert json.loads(tokens_json(tokens).first().json)[0]["surface"] == "Talk"
    assert render.token_table(tokens).orderBy("position").first().line.split()[:2] == ["0", "Talk"]
    fields = {(r.field, r.value) for r in render.raw_fields(tokens).filter("position = 0").collect()}
    assert (0, "Talk") in fields and all(v not in ("", "*") for _, v in fields)
    trace = [r.line for r in render.trace_lines(segment.decisions(tokens)).orderBy("position").collect()]
    assert trace[0].startswith("┌ NEW") and trace[0].endswith("sentence start") and any(x.startswith("│ attach") for x in trace)
    wide = spark.createDataFrame([(1, 0, "日本"), (1, 1, "x")], "doc_id long, position int, surface string")
    assert [(r.column, r.width) for r in render.graph_columns(wide).orderBy("position").collect()] == [(0, 4), (5, 1)]
    assert render.status_lines(tokens, analysis.primary).first().line.startswith(f"{tokens.filter('doc_id = 1').count()} tokens, ")
    graph = render.dot(tokens, analysis.primary).first().dot
    assert graph.startswith("digraph") and P.COLOURS["助詞"] in graph and '"root"' in graph
    found = legacy(tokens, compile_rules(Q.latin_rules()))
    assert found.filter("rule_id = 'latin-of-the'").count() == 1


def test_drawn_tree(analysis):
    nodes, edges = tree.render_model(analysis.nodes, analysis.edges, analysis.primary, analysis.tokens)
    kinds = {(r.kind, r.label) for r in nodes.filter("doc_id = 1").collect()}
    assert ("token", "town") in kinds and not any(k == "document" for k, _ in kinds)  # a lone sentence is the root
    assert edges.filter("doc_id = 1 and parent_id = 'document-0'").count() == 0
    assert tree.children(analysis.edges, "sentence-0").count() > 1 and tree.node(analysis.nodes, "sentence-0").count() == 1


def test_deep_trees_and_cycles(spark):
    chain = [(1, "document-0", "n0", 0)] + [(1, f"n{i}", f"n{i + 1}", 0) for i in range(99)] + [(1, "a", "b", 0), (1, "b", "c", 0), (1, "c", "a", 0)]
    nodes = spark.createDataFrame([(1, x) for x in ["document-0", *[f"n{i}" for i in range(100)], *"abc"]], "doc_id long, id string")
    edges = spark.createDataFrame(chain, "doc_id long, parent_id string, child_id string, `order` int")
    got = sorted((r.error, r.id) for r in tree.topology_errors(nodes, edges).collect())
    assert got == [(e, x) for e in ("cycle", "not connected to the root") for x in "abc"]


def test_text_functions(spark):
    row = spark.createDataFrame([("カタカナ ひ", "a &lt;b&gt; &#x41;&eacute;&amp;lt; &nosuch; <script>x</script>&nbsp;z", "*")], "kana string, html string, mark string")
    got = row.select(T.to_hiragana(F.col("kana")), T.plain_text(F.col("html")), T.null_marker(F.col("mark")), P.pos_color(F.lit("副詞")), P.pos_color(F.lit("x"))).first()
    assert tuple(got) == ("かたかな ひ", "a <b> Aé&lt; &nosuch; z", "", "#FDEDEC", "#F2F3F4")


def test_owner_guard(spark):
    examples = spark.createDataFrame([("r1",), ("nope",)], "rule_id string")
    assert [r.rule_id for r in evaluate.owner_guard(examples, examples.filter("rule_id = 'r1'")).collect()] == ["nope"]
    assert tokenize(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).count() == 0
