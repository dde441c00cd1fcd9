"""Packing, media, sharding, language ID and pages."""

import hashlib
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import langid, lines, media, packing, pages, sharding


# ------------------------------------------------------------------ packing


def test_packing_places_each_id_once(docs, documents, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.packed(docs).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    full = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        full += at == 1024
    assert len(by_seq) - full <= 3  # one for each partition
    once = {d: x for d, x, *_ in documents if d is not None and d != 7}
    for d, text in once.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in by_doc[7]) == 3 * by_doc[7][0].doc_tokens
    assert packing.packed(empty).count() == 0


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(0)
    packer = packing.VectorPacker(100, 4, 60, cut=False, pool=16)
    sizes = {i: (n, int(rng.integers(0, min(n, 60) + 1))) for i, n in enumerate(rng.integers(1, 90, 300).tolist())}
    placed = [x for i, (n, loss) in sizes.items() for x in packer.add(i, n, loss)] + list(packer.finish())
    assert sorted(p[0] for p in placed) == sorted(sizes)
    seqs = defaultdict(list)
    for key, start, length, seq, offset in placed:
        assert (start, length) == (0, sizes[key][0])
        seqs[seq].append(key)
    for keys in seqs.values():
        assert len(keys) <= 4 and sum(sizes[k][0] for k in keys) <= 100 and sum(sizes[k][1] for k in keys) <= 60
    with pytest.raises(ValueError):
        list(packer.add("large", 101, 0))


def test_packer_cuts_by_loss():
    packer = packing.VectorPacker(50, 8, 20)
    placed = [*packer.add("a", 90, 70), *packer.finish()]
    loss = defaultdict(int)
    for _, start, length, seq, _ in placed:
        loss[seq] += max(0, start + length - max(start, 20))
    assert max(loss.values()) <= 20 and sum(p[2] for p in placed) == 90


def test_pack_examples(spark):
    df = spark.createDataFrame([(1, 10, 4), (2, None, 1), (3, 20, None), (4, 5, 50)], "id long, n long, l long")
    rows = packing.pack_examples(df, "id", "n", "l").collect()
    assert sorted(r.key for r in rows) == [1, 3, 4]


# ------------------------------------------------------------------ media


def jpeg(width, height, comps, quant, blocks_of):
    """A small baseline encoder for tests: standard-shaped tables, EOB and zero runs, any sampling."""
    dc = [0x00, *([0] * 3 + [12] + [0] * 12), *range(12)]
    symbols = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
    ac = [0x10, *([0] * 7 + [162] + [0] * 8), *symbols]
    dc, ac = bytes(dc), bytes(ac)
    dcc, acc = media._codes(dc), media._codes(ac)
    bits = []

    def put(code, n):
        bits.extend((code >> (n - 1 - i)) & 1 for i in range(n))

    def value(v, n):
        put(v if v >= 0 else v + (1 << n) - 1, n)

    last = [0] * len(comps)
    h, v = max(c[0] for c in comps), max(c[1] for c in comps)
    if len(comps) == 1:
        across, down, order = -(-width // 8), -(-height // 8), [0]
    else:
        across, down, order = -(-width // (8 * h)), -(-height // (8 * v)), [i for i, c in enumerate(comps) for _ in range(c[0] * c[1])]
    made = []
    for _ in range(across * down):
        for c in order:
            block = blocks_of(c)
            made.append((c, block))
            diff, last[c] = block[0] - last[c], block[0]
            n = abs(diff).bit_length()
            put(*dcc[n])
            value(diff, n)
            run = 0
            end = max([k for k in range(1, 64) if block[k]], default=0)
            for k in range(1, end + 1):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    put(*acc[0xF0])
                    run -= 16
                n = abs(block[k]).bit_length()
                put(*acc[run << 4 | n])
                value(block[k], n)
                run = 0
            if end < 63:
                put(*acc[0])
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([i + 1, c[0] << 4 | c[1], 0]) for i, c in enumerate(comps))
    sos = bytes([len(comps)]) + b"".join(bytes([i + 1, 0]) for i in range(len(comps))) + bytes([0, 63, 0])
    return b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(0xDB, bytes([0, *quant])) + media._segment(0xC0, frame) + media._segment(0xC4, dc + ac) + media._segment(0xDA, sos) + scan + b"\xff\xd9", made


@pytest.mark.parametrize("comps", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_reader_on_general_baseline(comps):
    rng = np.random.default_rng(4)

    def block(_):
        b = [0] * 64
        b[0] = int(rng.integers(-60, 60))
        for k in rng.integers(1, 64, int(rng.integers(0, 9))):
            b[k] = int(rng.integers(-300, 300))
        return b

    stream, made = jpeg(37, 21, comps, [16] * 64, block)
    [(images, coefficients)] = media._decoded([stream])
    assert coefficients[0].tolist() == [b for _, b in made]
    assert (images[0].width, images[0].height) == (37, 21)
    thumb = media.thumbnail(images[0], coefficients[0])
    assert thumb.shape == (3, 5)
    assert thumb[0, 0] == min(255, max(0, 128 + made[0][1][0] * 16 // 8))


def test_damaged_streams(spark):
    good, _ = jpeg(16, 16, [(1, 1)], [1] * 64, lambda c: [3] + [0] * 63)
    rows = spark.createDataFrame([(1, good), (2, good[:40]), (3, b"junk"), (4, None), (5, good[:-6] + b"\xff\xd9")], "id long, media binary")
    quant = good.index(b"\xff\xdb")
    five = bytearray(good)
    five[good.index(b"\xff\xc0") + 9] = 5
    more = [(6, good[:quant] + good[quant + 69 :]), (7, good + b"\0\0"), (8, bytes(five))]
    rows = rows.unionByName(spark.createDataFrame([(i, bytes(x)) for i, x in more], "id long, media binary"))
    got = {r.id: r for r in media.read_images(rows).collect()}
    assert got[1].error is None and got[1].width == 16 and got[1].thumb_hash
    assert got[6].error and got[8].error and got[7].error is None and got[7].thumb_hash == got[1].thumb_hash
    assert got[2].error and got[3].error and got[4].error is None and got[4].width is None and got[5].error


def test_payload_round_trip(docs, documents, empty):
    stored = media.read_images(media.write_media(docs.select("doc_id", "text", F.lit(1).alias("width"))), payload=True)
    for r in stored.collect():
        assert r.error is None and bytes(r.payload) == media.pad_payload((r.text or "").encode())
    rows = {r.doc_id: r for r in media.digests(docs).collect() if r.doc_id is not None}
    for d, text, *_ in documents:
        if d is None:
            continue
        raw = media.pad_payload((text or "").encode())
        assert (rows[d].n_bytes, rows[d].payload_bytes, rows[d].payload_sha256, rows[d].tail_crc32) == (len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    assert media.digests(empty).count() == 0
    assert media.write_payloads([b"\xff" * 576 * (media.MOST_TILES + 1)])[0].count(b"\xff\xd8\xff\xdb") == 2


# ------------------------------------------------------------------ sharding


def brute_place(key, topology):
    def draw(name, weight):
        h = 42 if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=42)
        h = xxhash.xxh64_intdigest(name.encode(), seed=h)
        return -np.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    region = min(topology.tree, key=lambda r: draw(r, topology.weight(r)))
    rack = min(topology.tree[region], key=lambda q: draw(q, topology.weight(region, q)))
    leaves = topology.tree[region][rack]
    return min(leaves, key=lambda s: draw(f"shard-{s}", leaves[s])) if len(leaves) > 1 else next(iter(leaves))


def test_shards_against_brute_force(spark, docs, empty):
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    a, b = sharding.Topology.planned(24), sharding.Topology.planned(25)
    placed = sharding.place(sharding.place(keys, a), b, out="grown").collect()
    for r in placed[:400]:
        assert r.shard == brute_place(r.doc_id, a) and r.grown == brute_place(r.doc_id, b)
    assert all(r.grown in (r.shard, 24) for r in placed) and {r.shard for r in placed} == set(range(24))
    c = sharding.Topology.planned(26)
    assert all(r.third in (r.grown, 25) for r in sharding.place(sharding.place(keys, b, out="grown"), c, out="third").collect())
    assert sharding.number(sharding.place(empty, a)).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = sharding.Topology.planned(24)
    heavy = {r: {q: dict(s) for q, s in racks.items()} for r, racks in a.tree.items()}
    heavy["region-0"]["region-0/rack-1"][5] = 3.0
    moved = [r for r in sharding.place(sharding.place(keys, a), sharding.Topology(heavy), out="new").collect() if r.shard != r.new]
    assert moved
    for r in moved:  # nothing moves between two shards of a rack, or two racks of a region, whose weights stay
        assert r.new // 12 == 0 or r.shard // 12 == 0
        assert not (r.shard // 4 == r.new // 4 and r.new // 4 != 1)
        assert not (r.shard // 12 == r.new // 12 == 1)


def test_slots_have_no_gaps(docs):
    rows = sharding.number(sharding.place(docs.select("doc_id"), sharding.Topology.planned(24))).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sum(map(len, by.values())) == docs.count()


# ------------------------------------------------------------------ language ID


def brute_viterbi(scores, switch):
    best = [(list(scores[0]), [[i] for i in range(scores.shape[1])])]
    value, paths = list(scores[0]), [[i] for i in range(scores.shape[1])]
    for row in scores[1:]:
        new, ways = [], []
        for j in range(len(row)):
            k = max(range(len(row)), key=lambda i: (value[i] - (switch if i != j else 0), i == j))
            new.append(value[k] - (switch if k != j else 0) + row[j])
            ways.append(paths[k] + [j])
        value, paths = new, ways
    del best
    return max(value), paths


def test_viterbi_against_dynamic_programme():
    rng = np.random.default_rng(1)
    seqs = [rng.normal(size=(n, 3)).astype(np.float32) * 3 for n in (1, 7, 30, 4)] + [np.zeros((0, 3), np.float32)]
    for found, scores in zip(langid.viterbi(seqs, 2.0), seqs):
        assert len(found) == len(scores)
        if len(scores):
            total = sum(scores[i, s] for i, s in enumerate(found)) - 2.0 * int((np.diff(found) != 0).sum())
            assert abs(total - brute_viterbi(scores, 2.0)[0]) < 1e-3


def test_language_accuracy_and_cases(docs, documents, empty):
    model = langid.trained_model(docs)
    rows = langid.predict(docs, model, spans=True).collect()
    told = [(r.lang, r.lang_pred) for r in rows if r.lang and r.text and len(r.text) > 60]
    assert sum(a == b for a, b in told) / len(told) > 0.9
    for r in rows:
        assert 0 <= r.score <= 1
        if not r.text or not regex.search(r"\p{L}", r.text):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        else:
            assert r.lang_pred in model["langs"]
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_letters_and_marks():
    assert langid.words_of("½ ² Ⅷ ① 12_x हिन्दी e\u0301t\u0301é \u0301 日本語 a") == ["x", "हिन्दी", "e\u0301t\u0301é", "日本語", "a"]
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    want = "".join(c for c in text if unicodedata.category(c)[0] == "L")
    assert "".join(c for w in langid.words_of(text) for c in w if unicodedata.category(c)[0] == "L") == want
    assert langid.words_of("a \U00010400\U00010428 ½b") == ["a", "\U00010400\U00010428", "b"]


def test_held_out_accuracy(spark):
    """The whole query on the smallest table: it learns nothing from held-out rows and labels them rightly."""
    rows = langid.op6_viterbi_langid(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    told = [(r.lang_pred, docs[r.doc_id].lang) for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(told) > 20 and sum(a == b for a, b in told) / len(told) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_columns_may_clash(docs):
    clash = docs.withColumn("score", F.lit(99.5)).withColumn("__in", F.lit(1))
    out = langid.predict(clash, langid.trained_model(docs))
    assert set(out.columns) == {*clash.columns, "lang_pred"} and out.filter("score > 1").count() == 0


def test_rare_language_remains_a_candidate(spark):
    """A language with less than a thousandth of a script's words is still found where its words are clear."""
    common = " ".join(f"{a}{b}ing" for a in ("walk", "talk", "sing", "look", "read") for b in ("", "er", "let")) + " "
    rows = [(i, common * 60, "en") for i in range(40)] + [(100 + i, "ñandú quiñón señal mañana araña", "es") for i in range(4)]
    rows += [(200, "слово дело время " * 50, "ru"), (201, "слово дело время walking", "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df)).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_mixed_text_has_spans(docs, spark):
    model = langid.trained_model(docs)
    en = next(r for r in docs.filter("lang = 'en' and length(text) > 400").collect()).text.split()[:40]
    fr = next(r for r in docs.filter("lang = 'fr' and length(text) > 400").collect()).text.split()[:40]
    mixed = spark.createDataFrame([(1, " ".join(en + fr))], "doc_id long, text string")
    spans = langid.predict(mixed, model, spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "fr"] and sum(s.words for s in spans) >= 70


# ------------------------------------------------------------------ lines


def test_lines_join_ways_agree(docs, empty, monkeypatch):
    small = lines.drop_boilerplate(docs, counts=True).orderBy("doc_id", "text").collect()
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lines, "HOT_SHARE", 2)
    assert lines.drop_boilerplate(docs, counts=True).orderBy("doc_id", "text").collect() == small
    assert any(r.n_dropped for r in small) and not any("Site menu of all pages" in (r.text or "") for r in small)
    assert lines.drop_boilerplate(empty).count() == 0
    clash = docs.withColumnRenamed("lang", "lines").withColumn("host", F.lit("h")).withColumn("pages", F.lit(0))
    assert lines.drop_boilerplate(clash).columns == clash.columns


def test_lines_against_brute_force(docs, documents):
    hosts = defaultdict(list)
    for d, t, _, s, _ in documents:
        hosts[s or ""].append({x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")})
    bad = {h: {x for x in set().union(*p) if sum(x in q for q in p) >= lines.LEAST_PAGES and sum(x in q for q in p) > len(p) * lines.RATIO} for h, p in hosts.items()}
    want = sorted("" if t is None else "\n".join(x for x in t.split("\n") if not (x.strip(" ") and x.strip(" ") in bad[s or ""])) for _, t, _, s, _ in documents)
    assert sorted(r.text or "" for r in lines.drop_boilerplate(docs).collect()) == want


# ------------------------------------------------------------------ pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>x</p>";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav>
<div class="ad">Buy {n}</div><article><h1>Title &amp; {n}</h1><p><b>First
  line {n}<br><p>Second &eacute;</p><div class="ad">Inner ad</div><section id="comments"><p>Nice</p></section></article><aside>Side</aside><footer>&copy; x</footer>"""


def test_pages(spark):
    bare = "<div><p>Shared head</p><p>Own {n}</p><p>Shared foot</p></div>"
    rows = [(i, f"http://h/{i}", PAGE.replace("{n}", str(i)), 5) for i in range(3)] + [(10 + i, f"http://b/x/{i}?q", bare.replace("{n}", str(i)), 5) for i in range(3)]
    rows += [(20, None, None, 1), (21, "http://c/", "", 1), (22, "http://b/x/0", rows[3][2], 1), (23, "::bad", "<p>a<p>b", 1)]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), count=2).collect()}
    for i in range(3):
        assert got[i].text == f"Title & {i}\nFirst line {i}\nSecond é"
        assert got[i].n_chars == len(got[i].text)
    assert len(got) == len(rows) and got[20].text == "" == got[21].text and got[23].text == "a\nb"
    assert all("Own" in got[10 + i].text for i in range(3))
    one = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), count=1).collect()}
    assert [one[10 + i] for i in range(3)] == [f"Own {i}" for i in range(3)]


def test_pages_pair_over_partitions(spark):
    """The result is that of one sorted table, for any number of partitions; runs of copies may span some of them."""
    bare = "<div><p>Head of {h}</p><p>Group {g}</p><p>Own {n}</p><p>Foot of {h}</p></div>"
    rows = []
    for n in range(90):
        h, g = n // 13, n // 4 % 3
        body = bare.format(h=h, g=g, n=n if n % 10 < 6 and not 40 <= n < 60 else "copy")
        rows.append((n, f"http://h{h}/{'ab' if n % 3 else 'cd'}/{g}/{n:03d}", body))
    rows += [(None, "http://h1/z", bare), (200, None, bare), (200, None, bare), (201, "http://h9/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {c: sorted(map(str, pages.extract(df, count=c).collect())) for c in (1, 6, 211)}
    assert len(got[1]) == len(rows) and got[6] == got[211] == got[1]
    assert sum("text='Own" in x for x in got[1]) > 20 and not any("text='Head" in x and "Group 0\\nOwn 1\\n" in x for x in got[1])


def brute_text(rows):
    """The whole extraction over one sorted list."""

    def place(url):
        rest = (url or "").split("?")[0].split("#")[0]
        rest = rest.split("//", 1)[1] if "//" in rest else rest
        host, _, path = rest.partition("/")
        return host.lower(), "/" + path.strip("/")

    def near(a, b):
        return next((i for i, (x, y) in enumerate(zip(a.split("/"), b.split("/"))) if x != y), min(a.count("/"), b.count("/")) + 1)

    made = []
    for id_, url, html in rows:
        blocks = pages.page_blocks(html or "")
        made.append((*place(url), id_ is not None, id_ or 0, hashlib.md5((html or "").encode()).digest(), [b[0] for b in blocks], [b[1] for b in blocks]))
    made.sort(key=lambda m: m[:5])
    out = []
    for k, (host, path, known, id_, digest, lines, kinds) in enumerate(made):
        before = next((m for m in made[:k][::-1] if m[0] != host or m[4] != digest), None)
        behind = next((m for m in made[k + 1 :] if m[0] != host or m[4] != digest), None)
        sides = [m for m in (before, behind) if m and m[0] == host and m[5] != lines]
        if len(sides) == 2 and near(sides[1][1], path) > near(sides[0][1], path):
            sides.reverse()
        one = pages.shared_lines(lines, sides[0][5]) if sides else set()
        if 2 in kinds:
            kept = [x for x, kind in zip(lines, kinds) if kind == 2]
        else:
            kept = [x for i, x in enumerate(lines) if kinds[i] == 1 and i not in one]
        out.append((known, id_, "\n".join(kept), len(one)))
    return sorted(out)


def test_pages_against_brute_force(spark, monkeypatch):
    """Bare pages, articles, lines that pages quote from each other, copies, one host with most rows."""
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(260):
        host = "big.example" if rng.random() < 0.5 else f"h{rng.randrange(9)}.example"
        own = [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.2 and rows:
            own.append("Quoted line of some length")
        body = "".join(f"<p>{x}</p>" for x in own)
        if rng.random() < 0.5:
            html = f"<div><p>Head of {host}</p>{body}<p>Foot of {host}</p></div><div class=ad>Buy {rng.choice(words)}</div>"
        else:
            html = f"<nav><p>Menu</p></nav><article><p>Follow {host} today</p>{body}<p>All rights of {host}</p></article><p>Outside</p>"
        if rng.random() < 0.25 and rows:
            html = rng.choice(rows)[2]
        url = f"http://{host}/{rng.choice(['a', 'b', 'c/d'])}/{rng.randrange(40)}{rng.choice(['', '?q', '/', '#x'])}"
        rows.append((n if rng.random() < 0.97 else None, url, html if rng.random() < 0.97 else None))
    rows += [rows[0], rows[0], (5000, None, "<p>x"), (5001, None, "<p>x<p>y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = brute_text(rows)
    for count in (1, 6, 211):
        got = sorted((r.page_id is not None, r.page_id or 0, r.text, r.n_shared) for r in pages.extract(df, count=count).collect())
        assert got == want
    off = sorted(pages.settled("", *zip(*pages.page_blocks(html or "")), [])[0] if pages.page_blocks(html or "") else "" for _, _, html in rows)
    assert off != sorted(w[2] for w in want)
    assert sum("Head of" in w[2] for w in want) < sum("Head of" in x for x in off)


def test_pages_keep_what_an_article_holds(spark):
    html = "<article><p class=reply>One</p><p class='x share'>Two</p><math><mi>x</mi></math><div class=comments>No</div><p class=advert>No</p><p hidden>No</p></article>"
    df = spark.createDataFrame([(1, "http://a/b", html, "mine")], "page_id long, url string, html string, `range` string")
    assert pages.extract(df).first().text == "One\nTwo\nx"
    assert pages.extract(df.limit(0)).count() == 0


def test_longest_common_subsequence():
    import random

    rng = random.Random(2)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        taken = sorted(pages.shared_lines(a, b))
        assert len(taken) == length(a, b)
        it = iter(b)
        assert all(any(y == a[i] for y in it) for i in taken)
