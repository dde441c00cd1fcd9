import random

import pytest
from spanloom.operators import match
from spanloom.sources.catalog import CatalogError, Rule, Step, Variant, compile_rules, parse_toml

from model import all_matches, resolved

TOKEN = "doc_id long, position int, surface string, pos1 string, pos2 string, pos3 string, conj_form string, base_form string"


def rows_of(docs):
    return [(d, i, t["surface"], t.get("pos1", ""), "", "", "", t["surface"]) for d, tokens in docs.items() for i, t in enumerate(tokens)]


def compare(spark, docs, rules):
    tokens = spark.createDataFrame(rows_of(docs), TOKEN).repartition("doc_id")
    compiled = compile_rules(rules)
    keys = ("rule_id", "variant_id", "token_start", "token_end", "captures", "fallback", "core_specificity", "context_specificity", "priority", "wildcard_steps", "optional_steps")
    found = match.candidates(tokens, compiled).cache()
    got = {}
    for r in found.orderBy("doc_id", "identity").collect():
        got.setdefault(r.doc_id, []).append(tuple(tuple((c.name, c.token_start, c.token_end) for c in r.captures) if k == "captures" else r[k] for k in keys))
    short = {}
    for r in match.resolve(found).orderBy("doc_id", "identity").collect():
        short.setdefault(r.doc_id, []).append((r.rule_id, r.variant_id, r.token_start, r.token_end))
    for d, toks in docs.items():
        want = all_matches(toks, rules)
        assert got.get(d, []) == [tuple(m[k] for k in keys) for m in want], (d, toks)
        assert short.get(d, []) == [(m["rule_id"], m["variant_id"], m["token_start"], m["token_end"]) for m in resolved(want)], (d, toks)


def t(text):
    return [{"surface": x, "pos1": "N" if x in "ab" else "V"} for x in text.split()]


def s(surface=None, **k):
    fields = {"surface": surface} if surface else {}
    return Step({**fields, **k.pop("fields", {})}, **k)


def test_golden_cases(spark):
    gap = lambda a, b, **k: Step(gap=(a, b), **k)
    rules = [
        Rule("two-gaps", steps=[s("a"), gap(0, 2, capture="x"), s("b"), gap(0, 2, capture="y"), s("d")]),
        Rule("optional", steps=[s("a"), s("b", optional=True)], sense_id="s"),
        Rule("gap-end", steps=[s("a"), gap(0, 1)], fallback=True, sense_id="s"),
        Rule("left", variants=[Variant("v", [s("c")], left=[s(fields={"pos1": "N"})]), Variant("w", [s("c")], left=[s("a"), gap(0, 3)], absorb=True)], priority=3, ambiguity_group="g"),
        Rule("right", variants=[Variant("v", [s("c")], right=[gap(0, 2), s("d", capture="z")]), Variant("b", [s("b")], left_boundary="clause", right_boundary="sentence")], ambiguity_group="g"),
        Rule("one-of", steps=[Step(one_of=[{"surface": "x"}, {"surface": "y", "pos1": "V"}], capture="k"), s("b")]),
    ]
    docs = {1: t("a x b y c d"), 2: t("a x 、 b c d"), 3: t("a b"), 4: t("a b b"), 5: t("b 、 b 。 b c a c"), 6: t("y b x b c c d"), 7: []}
    compare(spark, docs, rules)


def test_random_cases_against_search(spark):
    rng = random.Random(5)

    def step():
        kind = rng.random()
        capture = rng.choice([None, None, "p", "q"])
        if kind < 0.25:
            low = rng.choice([0, 0, 1])
            return Step(gap=(low, low + rng.randint(0, 2)), capture=capture)
        fields = {"surface": rng.choice("abc.")} if rng.random() < 0.6 else {"pos1": rng.choice("NV")}
        one_of = [{"surface": rng.choice("abcd")} if rng.random() < 0.6 else {"pos1": rng.choice("NV")} for _ in range(rng.randint(0, 2))]
        return Step(fields if rng.random() < 0.8 or not one_of else {}, one_of, optional=rng.random() < 0.3, capture=capture)

    def seq(n):
        return [step() for _ in range(rng.randint(0, n))]

    rules = []
    for k in range(14):
        variants = [
            Variant(f"v{j}", seq(3) or [step()], seq(2), seq(2), rng.choice([None, None, "clause", "sentence"]), rng.choice([None, None, "clause"]), rng.random() < 0.3, rng.choice([None, 1, 5]), None, None, rng.choice([None, True]))
            for j in range(rng.randint(1, 2))
        ]
        rules.append(Rule(f"r{k}", steps=seq(3), variants=variants, priority=rng.randint(0, 2), sense_id=rng.choice([None, "s1", "s2"]), ambiguity_group=rng.choice([None, "g1", "g2"])))
    docs = {d: [{"surface": (x := rng.choice("aabbccd.")), "pos1": "N" if x in "ab" else "V"} for _ in range(rng.randint(1, 9))] for d in range(40)}
    compare(spark, docs, rules)


@pytest.mark.parametrize(
    "text",
    [
        "[[patterns]]\nid = ''\n[[patterns.steps]]\nsurface = 'a'",
        "[[patterns]]\nid = 'x'",
        "[[patterns]]\nid = 'x'\n[[patterns.steps]]\nwildcard = {min = 3, max = 1}",
        "[[patterns]]\nid = 'x'\n[[patterns.steps]]\nsurface = 'a'\nwildcard = {min = 0, max = 1}",
        "[[patterns]]\nid = 'x'\n[[patterns.steps]]\noptional = true",
        "[[patterns]]\nid = 'x'\n[[patterns.steps]]\nsurface = 'a'\ncapture = ''",
        "[[patterns]]\nid = 'x'\n[[patterns.variants]]\nid = 'a'\n[[patterns.variants.core]]\nsurface = 'a'\n[[patterns.variants]]\nid = 'a'\n[[patterns.variants.core]]\nsurface = 'a'",
        "[[patterns]]\nid = 'x'\n[[patterns.variants]]\nid = 'a'",
        "not toml",
    ],
)
def test_bad_catalogs(text):
    with pytest.raises(CatalogError):
        parse_toml(text, "test.toml")


def test_aliases_and_inheritance():
    rule = parse_toml("[[patterns]]\nid='r'\npriority=4\nsense_id='s'\n[[patterns.variants]]\nid='v'\nstart_boundary='clause'\nfallback=true\n[[patterns.variants.steps]]\none_of=['a',{pos1='N'}]\n[[patterns.variants.left]]\nsurface='b'", "t")[0]
    v = rule.effective()[0]
    assert (v.priority, v.sense_id, v.fallback, v.left_boundary, v.core[0].one_of, v.left[0].fields) == (4, "s", True, "clause", [{"surface": "a"}, {"pos1": "N"}], {"surface": "b"})
