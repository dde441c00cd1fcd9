"""Formation notation, compilation to rules, registries, imports and writers."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import match
from spanloom.operators.tokens import FEATURES
from spanloom.plans import compile as C
from spanloom.sources import notation as N
from spanloom.sources.catalog import CatalogError, compile_rules, load_builtin, load_dir, parse_toml, render_toml

HOSTS = N.Hosts(
    [
        N.Host("noun", ("noun", "person", "time"), ((("pos1", "名詞"),), (("pos1", "代名詞"),))),
        N.Host("verb", ("verb", "verb stem"), ((("pos1", "動詞"),),)),
        N.Host("adjective", ("adjective", "i-adjective"), ((("pos1", "形容詞"),),)),
        N.Host("phrase", ("phrase", "sentence", "clause"), (), (1, 40)),
    ]
)


@pytest.mark.parametrize(
    ("formation", "want"),
    [
        ("Verb + て", ["Verb + て"]),
        ("1. Noun ＋ に", ["Noun + に"]),
        ("Noun + に／へ", ["Noun + に", "Noun + へ"]),
        ("ため(or: x) + に", ["ため + に"]),
        ("まで (or から) + Noun", ["まで + Noun", "から + Noun"]),
        ("Noun + 為(ため)に", ["Noun + 為に", "Noun + ために"]),
        ("Noun / Verb + こと", ["Noun / Verb + こと"]),
        ("past / plain + こと", ["past / plain + こと"]),
        ("Noun + が, Verb + の", ["Noun + が", "Verb + の"]),
        ("Noun, person + が", ["Noun, person + が"]),
        ("Verb + ない; Verb + ん", ["Verb + ない", "Verb + ん"]),
        ("Verb + のに / Noun + なのに", ["Verb + のに", "Noun + なのに"]),
        ("は + あ / い + よ", ["は + あ + よ", "は + い + よ"]),
        ("Verb (remark) + て or Verb + で", ["Verb + て", "Verb + で"]),
        ("Noun + です.", ["Noun + です"]),
        ("", []),
    ],
)
def test_branches(formation, want):
    got = N.branches(formation, HOSTS)
    assert [" ".join(b.split()) for b in got] == want


def test_optional_parts():
    [branch] = N.branches("Verb + て(も)", HOSTS)
    assert [(n.kind, n.text, n.optional) for n in N.topology(branch, HOSTS)] == [("host", "Verb", False), ("literal", "て", False), ("literal", "も", True)]
    two = N.branches("Verb + (は/も)", HOSTS)
    assert [[(n.text, n.optional) for n in N.topology(b, HOSTS)] for b in two] == [[("Verb", False), ("は", True)], [("Verb", False), ("も", True)]]


def test_branches_are_bounded():
    assert len(N.branches("; ".join(f"Noun + {chr(0x3042 + i)}" for i in range(40)), HOSTS)) == N.MOST_BRANCHES


def test_hosts():
    assert [(a, b, h.name) for a, b, h in HOSTS.find("Verb stem, nouns noun")] == [(0, 9, "verb"), (17, 21, "noun")]
    assert HOSTS.only_hosts("(noun) / verb") and not HOSTS.only_hosts("noun に") and not HOSTS.only_hosts("に")
    with pytest.raises(N.NotationError):
        N.Hosts([N.Host("a", ("x",), ((("pos1", "y"),),)), N.Host("b", ("X",), (), (0, 1))])
    with pytest.raises(N.NotationError):
        N.Hosts([N.Host("a", ("x",))])


def test_topology():
    found = N.topology("noun / i-adjective + ば 3つ + sentence", HOSTS)
    assert [(n.kind, n.text, [h.name for h in n.hosts]) for n in found] == [("host", "noun / i-adjective", ["noun", "adjective"]), ("literal", "ば", []), ("literal", "3", []), ("host", "sentence", ["phrase"])]
    assert [h.name for h in N.topology("sentence noun + が", HOSTS)[0].hosts] == ["noun"]  # predicates go before gaps
    assert [n.text for n in N.topology("noun xて + て", HOSTS)] == ["noun", "て"]
    with pytest.raises(N.NotationError):
        N.topology("てform + て", HOSTS)


def features(surface):
    """Stand-in tags: some verbs and auxiliaries, all else particles."""
    kind = F.when(surface.isin("行く", "言う"), "動詞").when(surface.isin("ない", "ん"), "助動詞").otherwise("助詞")
    out = {f: F.lit("") for f in FEATURES}
    return out | {"pos1": kind, "base_form": F.when(surface == "ん", "ず").otherwise(surface)}


MEMBERS = [("negation", 0, "助動詞", "ない", "standard"), ("negation", 1, "助動詞", "ず", "formal"), ("negation", 2, "形容詞", "無い", "standard"), ("aspect", 0, "助動詞", "ぬ", "classical")]
ENTRIES = [
    ("r1", "て (te)", "Verb + て + person + は + noun", "N5", "after"),
    ("r2", "ない", "Verb + ない; Verb + ない", "N4", ""),
    ("r3", "行く (iku)", "noun or verb", "N3", "to go"),
    ("r4", "ん", "sentence + (ん)", None, None),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "rule_id string, title string, formation string, jlpt string, short_explanation string")


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(MEMBERS, "family string, ord int, pos1 string, base_form string, register string")


@pytest.fixture(scope="module")
def made(entries, members):
    return C.compile_entries(entries, HOSTS, members, ["standard"], features).cache()


def test_variants(made):
    drop = lambda x: {k: drop(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [drop(y) for y in x] if isinstance(x, list) else x
    got = {(r["rule_id"], r["variant_id"]): drop(r.asDict(True)) for r in made.collect()}
    noun = [{"pos1": "名詞"}, {"pos1": "代名詞"}]
    assert sorted(got) == [("r1", "formation-01"), ("r2", "formation-01"), ("r3", "title-01"), ("r4", "formation-01")]
    one = got["r1", "formation-01"]
    assert one["left_context"] == [{"pos1": "動詞"}] and one["right_context"] == [{"one_of": noun}]
    assert one["core"] == [{"surface": "て"}, {"wildcard": {"min": 1, "max": 24}, "capture": "slot_1"}, {"surface": "は"}]
    assert got["r2", "formation-01"]["core"] == [{"one_of": [{"pos1": "助動詞", "base_form": "ない"}, {"pos1": "形容詞", "base_form": "無い"}]}]
    assert got["r3", "title-01"]["core"] == [{"pos1": "動詞", "base_form": "行く"}]
    four = got["r4", "formation-01"]
    assert four["left_context"] == [{"wildcard": {"min": 1, "max": 24}}]
    assert four["core"] == [{"one_of": [{"pos1": "助動詞", "base_form": "ない"}, {"pos1": "形容詞", "base_form": "無い"}, {"pos1": "助動詞", "base_form": "ず"}], "optional": True}]


def test_written_catalog_is_read_back_and_matches(spark, entries, made, tmp_path):
    rules = C.to_rules(entries, made, ("filesystem", "Files"))
    assert parse_toml(render_toml(rules), "x", ("filesystem", "Files")) == rules
    builtin = load_builtin()
    assert parse_toml(render_toml(builtin), "x", ("builtin", "Built-in rules")) == builtin
    target = tmp_path / "catalog"
    assert C.write_catalog(target, rules, "{}") == {"N3": 1, "N4": 1, "N5": 1, "other": 1}
    assert sorted(p.name for p in target.iterdir()) == ["n3.toml", "n4.toml", "n5.toml", "other.toml", "regression.json"]
    assert sorted(r.id for r in load_dir(target)) == ["r1", "r2", "r3", "r4"]
    tokens = [("行く", "動詞"), ("て", "助詞"), ("人", "名詞"), ("は", "助詞"), ("私", "代名詞")]
    rows = [(1, i, s, p, "", "", "", "", "", s, "", 0, 0) for i, (s, p) in enumerate(tokens)]
    df = spark.createDataFrame(rows, f"doc_id long, position int, surface string, {', '.join(f'{f} string' for f in FEATURES)}, byte_start int, byte_end int")
    found = match.candidates(df, compile_rules(load_dir(target))).filter("rule_id = 'r1'").collect()
    assert [(r.token_start, r.token_end, [(c.name, c.token_start) for c in r.captures]) for r in found] == [(1, 3, [("slot_1", 2)])]


def test_folder_is_replaced_as_a_whole(tmp_path, monkeypatch):
    target = tmp_path / "out"
    C.replace_folder(target, {"a": "1", "b": "2"})
    C.replace_folder(target, {"c": "3"})
    assert [p.name for p in target.iterdir()] == ["c"]
    with pytest.raises(TypeError):
        C.replace_folder(target, {"d": None})
    assert [p.name for p in target.iterdir()] == ["c"] and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(CatalogError):
        C.write_catalog(target, [load_builtin()[0].__class__("x")])


def test_unreadable_formation_is_an_error(spark, members):
    bad = spark.createDataFrame([("r9", "て", "gerund + unknown")], "rule_id string, title string, formation string")
    with pytest.raises(N.NotationError, match="r9"):
        C.compile_entries(bad, HOSTS, members, ["standard"], features)
    assert C.compile_entries(bad.limit(0), HOSTS, members, ["standard"], features).count() == 0


def test_registry_audits(spark, members):
    inventory = spark.createDataFrame([("助動詞", "ない"), ("助動詞", "ず"), ("助動詞", "ぬ"), ("助動詞", "だ")], "pos1 string, base_form string")
    twice = members.unionByName(spark.createDataFrame([("aspect", 1, "助動詞", "ず", "formal")], members.schema))
    got = sorted(tuple(r) for r in C.inventory_audit(inventory, twice).collect())
    assert got == sorted([("助動詞", "だ", "in no family"), ("形容詞", "無い", "not in the inventory"), ("助動詞", "ず", "in several families")])
    assert [r.pos1 for r in C.unknown_class_leaks(spark.createDataFrame([("名詞",), ("助動詞",)], "pos1 string")).collect()] == ["助動詞"]


RAW = "id long, title string, level string, meaning string, nuance_translation string, casual_structure string, polite_structure string"


def test_points_and_enrichments(spark):
    raw = spark.createDataFrame(
        [
            (1, "<b>は</b> &amp; が", "JLPT5", "", "topic", "Noun + は<br>Example:<br/>(1) note<br>Negative: Noun + では → Noun + じゃ<sup>x</sup>", "Noun + は, pronounced wa\nNoun<rt>x</rt> + が&#33;&hearts;"),
            (2, "だけ", "3", "only", None, None, ""),
            (3, " ", "", None, None, "<sup>1</sup> gone", None),
        ],
        RAW,
    )
    points = C.flatten_points(raw)
    got = [(r.source_id, r.title, r.level, r.meaning_en, r.form_id, r.text) for r in points.orderBy("source_id", "form_no").collect()]
    assert got == [
        ("1", "は & が", "N5", "topic", "casual-01", "Noun + は"),
        ("1", "は & が", "N5", "topic", "casual-02", "Noun + じゃ"),
        ("1", "は & が", "N5", "topic", "polite-01", "Noun + は"),
        ("1", "は & が", "N5", "topic", "polite-02", "Noun + が!♥"),
        ("2", "だけ", "N3", "only", "title", "だけ"),
    ]
    form = "title string, forms array<struct<id:string,text:string>>"
    more = C.merge_enrichments(points, spark.createDataFrame([("だけ", [("a", "Noun + だけ"), ("b", "Verb + だけ")])], form))
    assert [(r.form_id, r.text) for r in more.filter("source_id = '2'").orderBy("form_no").collect()] == [("title", "だけ"), ("enrichment-a", "Noun + だけ"), ("enrichment-b", "Verb + だけ")]
    for bad in ([("nope", [("a", "x")])], [("だけ", [("a", "x")]), ("だけ", [("b", "x")])], [("だけ", [("", "x")])], [("だけ", [("a", "x"), ("a", "y")])], [("だけ", [])]):
        with pytest.raises(CatalogError):
            C.merge_enrichments(points, spark.createDataFrame(bad, form))


def test_manifest(spark):
    schema = "rule_id string, jlpt string, file string, source_index int, title string, formation string, examples array<struct<jp:string,romaji:string,en:string>>"
    entries = spark.createDataFrame([("a", "N5", "f5", 1, "t", None, [("x", None, "y"), ("z", "", "")]), ("b", "N4", "f4", 1, "u", "g", None)], schema)
    digests = spark.createDataFrame([("f5", "55"), ("f4", "44")], "file string, sha256 string")
    whole = json.loads(C.manifest_json(entries, digests).first().json)
    assert whole["logical_rules"] == 2 and [x["example_index"] for x in whole["examples"]] == [1, 2] and whole["examples"][0]["romaji"] == ""
    assert [(f["name"], f["entries"], f["examples"]) for f in whole["source"]["files"]] == [("f4", 1, 0), ("f5", 1, 2)]
    import hashlib

    assert whole["source"]["aggregate_sha256"] == hashlib.sha256(b"f444f555").hexdigest()
