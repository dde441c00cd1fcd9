"""Substring dedup, Jaccard join, embeddings and the pipeline against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import blocks, neighbours, ngramjoin, substrings


def brute_repeats(documents, size=13):
    first, words = {}, [(d if d is not None else substrings.NO_ID, (t or "").encode().split()) for d, t, *_ in documents]
    for d, w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [200_000, 2_000])
def test_substrings(docs, documents, empty, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    got = sorted((r.doc_id if r.doc_id is not None else substrings.NO_ID, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect())
    assert got == brute_repeats(documents)
    assert sum(g[2] for g in got) > 100
    if size > 10_000:
        assert substrings.digests(empty).count() == 0
        clash = docs.withColumnRenamed("lang", "block").withColumn("row", F.lit(3))
        kept = substrings.remove_repeats(clash)
        assert kept.columns == clash.columns and kept.count() == docs.count()
        want = Counter(x[3] for x in brute_repeats(documents))
        assert Counter(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in kept.collect()) == want


def test_spans_have_sources(docs, documents):
    words = {d: (t or "").split() for d, t, *_ in documents if d is not None}
    found = substrings.spans(docs).collect()
    assert found
    for r in found:
        if r.doc_id is not None:
            run = words[r.doc_id][r.first : r.first + r.words]
            assert r.source < r.doc_id and r.words >= 13
            assert run == words[r.source][r.source_first : r.source_first + r.words]
    assert max(r.words for r in found) > 50


def brute_components(documents, percent=75):
    sets = {}
    for d, t, *_ in documents:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {d: find(d) for d in ids}


@pytest.mark.parametrize(("size", "cap"), [(200_000, 1024), (2_000, 3)])
def test_jaccard_components(docs, documents, empty, monkeypatch, size, cap):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    monkeypatch.setattr(ngramjoin, "CAP", cap)
    monkeypatch.setattr(ngramjoin, "PIECE", 4096 if cap > 3 else 5)
    sets, root = brute_components(documents)
    got = ngramjoin.jaccard_classes(docs).collect()
    assert len(got) == len(documents)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id][0]), root[r.doc_id]), r
    assert len(set(root.values())) < len(root) - 10
    if cap > 3:
        assert ngramjoin.jaccard_classes(empty).count() == 0
        kept = ngramjoin.near_duplicates(docs)
        assert kept.columns == docs.columns
        want = [(d, t) for d, t, *_ in documents if d is not None and root[d] == d]
        want = [x for x in want if not (x[1] or "").split()] + list({x for x in want if (x[1] or "").split()})
        assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == sorted((d, t or "") for d, t in want)
        clash = docs.withColumnRenamed("lang", "__id").withColumn("__go", F.lit(1)).withColumn("component_id", F.lit(2))
        assert ngramjoin.near_duplicates(clash).columns == clash.columns


def thue_morse(power):
    x, y = "a", "b"
    for _ in range(power):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("around", ["", "xy"])
def test_words_that_defeat_polynomial_hashes(spark, around):
    pairs = [tuple(around + w + around for w in thue_morse(power)) for power in (10, 11, 12, 13)]
    head = [f"w{i}" for i in range(12)]
    rows = [(2 * i + side, " ".join([*head[:12], pair[side]])) for i, pair in enumerate(pairs) for side in range(2)]
    rows += [(100 + 2 * i + side, " ".join([pair[side]] * 3)) for i, pair in enumerate(pairs) for side in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(df).collect())
    assert got == brute_repeats(rows)
    _, root = brute_components(rows)
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_classes(df).collect()} == root


def test_tree_prunes_no_link():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.int64).astype(np.uint64))
    sets = []
    for _ in range(60):
        own = rng.integers(0, 1 << 62, int(rng.integers(0, 160)), dtype=np.int64).astype(np.uint64)
        sets.append(np.unique(np.concatenate([rng.choice(base, int(rng.integers(200, 400)), replace=False), own])))
    pairs = {tuple(sorted(p)) for part in ngramjoin.SignatureTree(sets, 75).pieces() for p in part.tolist()}
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if ngramjoin.linked(sets[a], sets[b], 75)}
    assert links <= pairs and links


def brute_links(rows):
    sound = [(i, l, np.array(v, np.float64)) for i, v, l in rows if i is not None and l is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = defaultdict(list)
    for i, l, v in sound:
        groups[l, len(v)].append((i, v))
    for g in groups.values():
        x = np.array([v for _, v in g])
        hit = neighbours.cosines(x, x) >= 0.98
        np.fill_diagonal(hit, False)
        for a, b in zip(*np.nonzero(hit)):
            n[g[a][0]] += 1
            p, q = find(g[a][0]), find(g[b][0])
            root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i, *_ in rows}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for c in range(30):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 12)) if c else 80):
            rows.append((k, [float(x) for x in centre + rng.standard_normal(24) * 0.14], int(c % 3)))
            k += 1
    rows += [(k + i, rows[0][1], 0) for i in range(40)]
    k += 40
    rows += [(k, None, 0), (k + 1, [0.0] * 24, 0), (k + 2, [float("nan")] * 24, 0), (k + 3, rows[0][1], None), (k + 4, [1.0, 2.0], 0), (k + 5, [2.0, 4.0], 0), (k + 6, [], 0), (k + 7, [None, 1.0], 0), (k + 8, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [tuple(r) for r in df.collect()]
    report: dict = {}
    clash = df.withColumn("root", F.lit("x")).withColumn("id", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(clash, report=report).collect()}
    assert got == brute_links(rows) and report["audited_links"] > 0
    assert neighbours.near_duplicates(df.limit(0)).count() == 0
    named = df.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(named).collect()} == got
    with pytest.raises(ValueError, match="float"):
        neighbours.near_duplicates(df.withColumn("embedding", F.col("embedding").cast("array<double>")))


def test_embeddings_of_two_dense_groups(spark):
    """Two groups of more than WIDTH links a vector, which a single pair joins; each end has many nearer partners."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    angle = np.arccos(0.98) * 0.995
    rows = []
    for pair in range(6):
        # An end lies on the brink of each group; all others of its group lie behind it, away from the other group.
        for side, sign in ((0, -1), (1, 1)):
            for k in range(220):
                turn = sign * (angle / 2 + (0.005 + rng.random() * 0.1 if k else 0))
                v = np.cos(turn) * axes[2 * pair] + np.sin(turn) * axes[2 * pair + 1]
                rows.append((len(rows), [float(x) for x in v + (rng.standard_normal(24) * 0.002 if k else 0)], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links([tuple(r) for r in df.collect()])
    assert len({w[1] for w in want.values()}) == 6
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df, tables=1).collect()}
    assert got == want


def test_embeddings_without_recall(spark, monkeypatch):
    """Where the hyperplanes find no pair at all, the audit leads to the exact comparison."""
    monkeypatch.setattr(neighbours, "TABLES_MOST", 1)
    monkeypatch.setattr(neighbours, "start", lambda reps, *_: reps.sparkSession.createDataFrame([], neighbours.EDGE))
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 24))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.standard_normal(24) * 0.1], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df, tables=1).collect()}
    assert got == brute_links([tuple(r) for r in df.collect()])


def brute_pipeline(documents):
    """The five stages on plain rows: {doc_id: token ids with the end id}."""
    import public_tokenizers as P
    import regex
    from tokenizers import Tokenizer

    from spanloom.llm import lines

    rows = [(d, t, s) for d, t, _, s, _ in documents if t and regex.search(r"\p{L}", t)]
    pages = defaultdict(list)
    for _, t, s in rows:
        pages[s or ""].append({x.strip(" ") for x in t.split("\n") if x.strip(" ")})
    bad = {h: {x for x, n in Counter(x for p in ps for x in p).items() if n >= lines.LEAST_PAGES and n > lines.RATIO * len(ps)} for h, ps in pages.items()}
    rows = [(d, "\n".join(x for x in t.split("\n") if not (x.strip(" ") and x.strip(" ") in bad[s or ""]))) for d, t, s in rows]
    _, root = brute_components(rows)
    seen, kept = set(), []
    for d, t in rows:
        if d is None or (root[d] == d and (not t.split() or (d, t) not in seen)):
            seen.add((d, t))
            kept.append((d, t))
    words = [(substrings.NO_ID if d is None else d, t.encode().split()) for d, t in kept]
    first: dict = {}
    for d, w in words:
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d), d)
    library, out = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}
    for (d, t), (n, w) in zip(kept, words):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < n:
                gone[i : i + 13] = [True] * 13
        text = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t
        out.setdefault(d, []).append([*library.encode(text, add_special_tokens=False).ids, 0])
    return out


def test_pipeline(spark, docs, documents, tmp_path):
    import zlib

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_pipeline(documents)
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    assert set(pieces) == set(want) and 203 not in want
    for d, found in pieces.items():
        texts = want[d]
        assert sum(r.length for r in found) == sum(map(len, texts))
        if len(texts) > 1:
            continue  # one id for several documents: their pieces can't be told apart
        [ids], at = texts, 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_pipeline_keeps_all_columns(spark, docs, tmp_path):
    import corpus_pipeline

    names = ("score", "lang_pred", "row", "block", "__go", "component_id", "host")
    clash = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, clash, "")
        assert after.columns == clash.columns, name
        assert after.select(*names).distinct().collect() == [tuple(f"own {c}" for c in names)], name
        assert stage(spark, clash.limit(0), "").count() == 0, name
    assert corpus_pipeline.pack(spark, clash.limit(0), "").count() == 0
