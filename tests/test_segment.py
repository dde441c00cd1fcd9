from spanloom.operators import rank, segment, tree
from spanloom.operators.tokens import FEATURES, clean_features, split_tokens, tile_errors, tokenize, tokenize_with
from spanloom.plans.analyze import Analyzer, document_json, parse_documents
from spanloom.plans.requests import MOST_BODY, MOST_TEXT, check
from spanloom.sources.catalog import load_builtin

TOKEN = "doc_id long, position int, surface string, pos1 string, pos2 string, pos3 string, pos4 string, conj_type string, conj_form string, base_form string, reading string, byte_start int, byte_end int"


def tagged(spark, docs):
    rows = []
    for d, words in docs.items():
        at = 0
        for i, w in enumerate(words):
            surface, pos1, *more = (w.split("/") + ["", "", "", ""])[:6]
            n = len(surface.encode())
            rows.append((d, i, surface, pos1, more[0], more[1], "", "", more[2], more[3] or surface, "", at, at + n))
            at += n
    return spark.createDataFrame(rows, TOKEN)


def surfaces(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.position)):
        out.setdefault(r.doc_id, {}).setdefault(r.sentence_id, {}).setdefault(r.bunsetsu_id, []).append(r.surface)
    return {d: ["|".join("".join(p) for p in s.values()) for s in v.values()] for d, v in out.items()}


def test_phrases(spark):
    docs = {
        1: ["わたし/代名詞", "の/助詞/格助詞", "友達/名詞/普通名詞", "も/助詞/係助詞", "来/動詞/一般", "た/助動詞"],
        2: ["食べ/動詞/一般//連用形-一般", "て/助詞/接続助詞", "は/助詞/係助詞", "いけ/動詞/非自立可能//未然形", "ない/助動詞"],
        3: ["東京/名詞/固有名詞", "に/助詞/格助詞", "は/助詞/係助詞", "行っ/動詞/非自立可能", "た/助動詞"],
        4: ["昨日/名詞/普通名詞/副詞可能", "本/名詞/普通名詞", "屋/名詞/普通名詞", "は/助詞/係助詞"],
        5: ["いなべ/名詞/固有名詞", "市/名詞/普通名詞", "藤原/名詞/固有名詞", "町/名詞/普通名詞"],
        6: ["勉強/名詞/普通名詞/サ変可能", "する/動詞/非自立可能///為る"],
        7: ["行き/動詞/一般", "！/補助記号/句点", "「/補助記号/括弧開", "はい/感動詞", "。/補助記号/句点", "」/補助記号/括弧閉", "と/助詞", "言う/動詞/一般"],
        8: ["強/形容詞/一般//語幹-一般", "すぎる/動詞/非自立可能"],
        9: ["イき/動詞/一般", "そう/形状詞/助動詞語幹", "関係者/名詞/普通名詞", "の/助詞", "よう/形状詞/助動詞語幹"],
    }
    got = surfaces(segment.phrases(tagged(spark, docs)))
    assert got == {
        1: ["わたしの|友達も|来た"], 2: ["食べてはいけない"], 3: ["東京には|行った"], 4: ["昨日|本屋は"], 5: ["いなべ市|藤原町"], 6: ["勉強する"],
        7: ["行き！", "「はい。」", "と|言う"], 8: ["強すぎる"], 9: ["イきそう|関係者の|よう"],
    }


def test_every_token_in_one_phrase(spark):
    import random

    rng = random.Random(1)
    kinds = ["名詞/普通名詞", "助詞", "補助記号/句点", "補助記号/括弧閉", "補助記号/括弧開", "動詞/一般", "接頭辞"]
    docs = {d: [f"{rng.choice('abc!')}/{rng.choice(kinds)}" for _ in range(rng.randint(1, 30))] for d in range(60)}
    rows = segment.phrases(tagged(spark, docs)).collect()
    for d, words in docs.items():
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(words)))
        # sentences by the loop that the windows stand for
        ends, i = [], 0
        ends_here = lambda w: w.split("/")[2:3] == ["句点"] or w[0] == "!"
        while i < len(words):
            if ends_here(words[i]):
                while i + 1 < len(words) and (ends_here(words[i + 1]) or words[i + 1].endswith("括弧閉")):
                    i += 1
                ends.append(i)
            i += 1
        want, s = [], 0
        for p in range(len(words)):
            want.append(s)
            s += p in ends
        assert [r.sentence_id for r in mine] == want


def test_tokens_tile(spark):
    docs = spark.createDataFrame([(1, "Ab, c1  é!"), (2, ""), (3, None), (4, "\n")], "doc_id long, text string")
    rows = sorted(split_tokens(docs).collect())
    assert [(r.surface, r.byte_start, r.byte_end) for r in rows] == [("Ab", 0, 2), (",", 2, 3), ("c", 4, 5), ("1", 5, 6), ("é", 8, 10), ("!", 10, 11)]
    assert tile_errors(tokenize(docs)).count() == 0
    made = tokenize_with(docs, lambda t: [(w, "名詞", *["*"] * 7) for w in t.split()])
    assert [(r.surface, r.pos1, r.pos2, r.byte_start) for r in sorted(made.collect())] == [("Ab,", "名詞", "", 0), ("c1", "名詞", "", 4), ("é!", "名詞", "", 8)]
    assert clean_features(made).columns == made.columns and set(FEATURES) <= set(made.columns)


CAND = "doc_id long, rule_id string, variant_id string, rule_name string, jlpt string, meaning_en string, hint string, sense_id string, ambiguity_group string, source struct<id:string,label:string>, captures array<struct<name:string,token_start:int,token_end:int>>, token_start int, token_end int, fallback boolean, core_specificity int, context_specificity int, priority int, wildcard_steps int, optional_steps int, discovery int, identity int"


def cands(spark, rows):
    made = [(1, r, "default", name, jlpt, meaning, None, None, None, (src, src), [], s, e, fb, core, 0, prio, 0, 0, i, i) for i, (r, name, meaning, jlpt, src, s, e, fb, core, prio) in enumerate(rows)]
    return spark.createDataFrame(made, CAND)


def shown(pair):
    primary, secondary = pair
    return (
        [(r.id, r.rule_name, len(r.provenance)) for r in rank.in_order(primary).collect()],
        sorted((r.secondary_id, r.id, r.reason, r.blocked_by) for r in secondary.collect()),
    )


def test_ranking(spark):
    rows = [
        ("a", "A", "one", "N5", "x", 3, 3, False, 1, 0),
        ("b", "B", "two", "N2", "x", 1, 3, False, 1, 0),
        ("c", "Ｃ  c", "Same", "N5", "x", 6, 7, False, 1, 0),
        ("d", "ｃ　C", " same ", "N5", "y", 6, 7, False, 2, 0),
        ("e", "E", "e", "N1", "x", 7, 9, False, 1, 0),
        ("f", "F", "f", "N5", "x", 9, 9, True, 9, 9),
        ("g", "G", "g", "N4", "x", 12, 12, False, 1, 0),
        ("h", "H", "h", "N5", "x", 12, 12, False, 1, 0),
    ]
    got = shown(rank.rank(cands(spark, rows)))
    assert got == shown(rank.rank(cands(spark, rows[::-1])))
    assert [g[:2] for g in got[0]] == [("match-1-3", "B"), ("match-7-9", "E"), ("match-12-12", "H")]
    assert ("secondary-3-3-0", "match-3-3", rank.CONTAINED, "match-1-3") in got[1]
    assert ("secondary-6-7-0", "match-6-7", rank.OVERLAPS, "match-7-9") in got[1]
    assert ("secondary-9-9-0", "match-9-9", rank.CONTAINED, "match-7-9") in got[1]
    assert ("secondary-12-12-0", "match-12-12-1", rank.CONTAINED, "match-12-12") in got[1]
    alone, _ = rank.rank(cands(spark, rows[2:4]))
    r = alone.first()
    assert [(p.source.id, p.rule_id) for p in r.provenance] == [("x", "c"), ("y", "d")] and r.rule_name == "ｃ　C"


def test_selection_against_loop(spark):
    import random

    rng = random.Random(9)
    rows = [(f"r{i}", f"n{i}", f"m{i}", f"N{rng.randint(1, 5)}", "x", (s := rng.randint(0, 40)), s + rng.randint(0, 6), rng.random() < 0.2, rng.randint(1, 3), rng.randint(0, 2)) for i in range(60)]
    order = sorted(rows, key=lambda r: (r[7], -r[9], -(r[6] - r[5]), -r[8], -int(r[3][1]), r[0]))
    kept = []
    for r in order:
        if not any(r[5] <= k[6] and k[5] <= r[6] for k in kept):
            kept.append(r)
    primary, secondary = rank.rank(cands(spark, rows))
    assert sorted(r.rule_name for r in primary.collect()) == sorted(k[1] for k in kept)
    assert secondary.count() == len(rows) - len(kept)


def test_analysis_and_tree(spark):
    docs = spark.createDataFrame([(1, "そしてなによりも"), (2, "")], "doc_id long, input string")
    tokens = tagged(spark, {1: ["そして/接続詞", "なに/代名詞", "より/助詞", "も/助詞/係助詞"]})
    a = Analyzer([r for r in load_builtin() if r.id.startswith("ja-")]).of_tokens(docs, tokens)
    nodes = {(r.doc_id, r.id): r for r in a.nodes.collect()}
    assert nodes[2, "document-0"].token_start is None and nodes[1, "bunsetsu-0-1"].match_ids == ["match-1-3"]
    assert nodes[1, "bunsetsu-0-1"].secondary_match_ids == ["secondary-1-2-0", "secondary-3-3-0"]
    assert tree.topology_errors(a.nodes, a.edges).count() == 0
    out = document_json(a)
    texts = {r.doc_id: r.json for r in out.collect()}
    assert '"token_start":null' in texts[2] and '"tokens":[]' in texts[2] and '"schema_version":3' in texts[1]
    bad = spark.createDataFrame([("{}",), ("x",), (texts[1],)], "json string")
    assert [r.shape_error for r in parse_documents(bad).collect()] == ["lacks schema_version", "not an object", None]


def test_topology_errors(spark):
    nodes = spark.createDataFrame([(1, i) for i in ("document-0", "a", "b", "c", "d", "a")], "doc_id long, id string")
    edges = spark.createDataFrame([(1, "document-0", "a", 0), (1, "b", "c", 0), (1, "c", "b", 0), (1, "document-0", "d", 1), (1, "a", "d", 0), (1, "x", "y", 0)], "doc_id long, parent_id string, child_id string, `order` int")
    got = {(r.error, r.id) for r in tree.topology_errors(nodes, edges).collect()}
    assert {("duplicate id", "a"), ("missing parent", "x"), ("missing child", "y"), ("several parents", "d"), ("not connected to the root", "b"), ("not connected to the root", "c")} <= got


def test_requests(spark):
    ok, js = "/api/analyze", "application/json"
    rows = [
        (1, "POST", ok, js, '{"text": "a"}'), (2, "POST", ok, js, '{"text": ""}'), (3, "POST", ok, js, '{"text": 3}'), (4, "POST", ok, js, '{"text": "a", "b": 1}'),
        (5, "POST", ok, "text/plain", '{"text": "a"}'), (6, "GET", ok, js, ""), (7, "GET", "/x", js, ""), (8, "GET", "/api/health", None, None), (9, "POST", ok, js, "nope"),
        (10, "POST", ok, js, '{"text": "' + "a" * MOST_BODY + '"}'), (11, "POST", ok, js, '{"text": "' + "a" * (MOST_TEXT + 1) + '"}'), (12, "POST", ok, js, '{"text": " 　"}'), (13, "POST", ok, js, "{}"),
    ]
    got = {r.id: (r.status, r.code) for r in check(spark.createDataFrame(rows, "id long, method string, path string, content_type string, body string")).collect()}
    bad = (400, "invalid_json")
    assert got == {1: (200, None), 2: (400, "empty_input"), 3: bad, 4: bad, 5: (415, "unsupported_media_type"), 6: (405, "method_not_allowed"), 7: (404, "not_found"), 8: (200, None), 9: bad, 10: (413, "request_too_large"), 11: (413, "input_too_large"), 12: (400, "empty_input"), 13: bad}
