import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(library, documents):
    work = bpe.Replay.of_ranks(open(MULTI, "rb").read(), P.PATTERN)
    texts = [r[1] or "" for r in documents] + ["aaaa" * 900, "he'll don't  \n  x", "　 x 　y  z   ", "a \x1c b", "x  y"]
    got = [ids[x:y] for _, _, ids, edges in bpe.encoded(work, pa.array(texts)) for x, y in zip(edges, edges[1:])]
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [work.decode(g) for g in got] == [t.encode() for t in texts]


def test_long_words_and_waves_agree(library):
    work = bpe.Replay.of_ranks(open(MULTI, "rb").read(), P.PATTERN)
    words = ["th" * 40, "x" * 65, "x" * 64, "tionation" * 9, "é" * 33, "abc"]
    assert [np.frombuffer(i, "<u4").tolist() for i in work.replay([w.encode() for w in words])] == [work.encode(w) for w in words] == [library.encode_ordinary(w) for w in words]


def test_json_vocabulary():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    work = bpe.Replay.of_json(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN)
    texts = ["Thesen anenen, heonre.\nAnou ly", "<|endoftext|> a  b", "日本 ñ 45.6%", "", "q" * 500]
    assert [work.encode(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_cuts_change_no_match():
    """Rows of spaces, line feeds, marks and letters side by side, all in one block, against the library."""
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    work = bpe.Replay.of_json(open(P.path("byte_bpe_50k.json"), "rb").read(), bpe.SPACED)
    draw = random.Random(5)
    pieces = [" ", " ", "\n", "\n", "\r", "\t", "\u3000", "\xa0", "\x1c", ".", ",", "!", "'s", "'", "re", "a", "The", "é", "日", "7", "½", "<|endoftext|>"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 9))) for _ in range(6000)]
    got = [ids[x:y].tolist() for _, _, ids, edges in bpe.encoded(work, pa.array(texts)) for x, y in zip(edges, edges[1:])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_query_rows(docs, documents, empty, library):
    rows = bpe.digests(docs, MULTI, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == sorted((d is None, d or 0, len(library.encode_ordinary(t or ""))) for d, t, *_ in documents)
    by = {d: t or "" for d, t, *_ in documents if d is not None}
    for r in rows:
        if r.doc_id is not None:
            ids = np.array(library.encode_ordinary(by[r.doc_id]), dtype="<u4").tobytes()
            assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(by[r.doc_id].encode()).hexdigest())
    assert bpe.digests(empty, MULTI, P.PATTERN).count() == 0


def test_columns_and_round_trip(docs):
    clash = docs.withColumn("ids", F.lit("mine")).withColumn("block", F.lit(1))
    out = bpe.decode(bpe.encode(clash, MULTI, P.PATTERN), MULTI)
    assert set(out.columns) == {*docs.columns, "block", "ids", "decoded"}
    assert out.filter(F.coalesce("text", F.lit("")) != F.decode("decoded", "UTF-8")).count() == 0


def thue_morse(power, a="a", b="b"):
    """Two words of 2 ** power letters, which every polynomial hash modulo 2 ** 64 takes for equal."""
    x, y = a, b
    for _ in range(power):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("around", ["", "xy"])
def test_words_that_defeat_polynomial_hashes(library, around):
    from tokenizers import Tokenizer

    words = [around + w + around for power in (5, 10, 11, 12, 13) for w in thue_morse(power)]
    multi, single = bpe.Replay.of_ranks(open(MULTI, "rb").read(), P.PATTERN), bpe.Replay.of_json(open(P.path("byte_bpe_50k.json"), "rb").read(), bpe.SPACED)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = " ".join(words)
    assert multi.encode(text) == library.encode_ordinary(text)
    assert single.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_equal_hashes_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(bpe, "hash_words", lambda raw, starts, ends, seed: (ends - starts).astype(np.uint64))
    work = bpe.Replay.of_json(open(P.path("byte_bpe_50k.json"), "rb").read(), bpe.SPACED)
    text = "one two six ten " + " ".join(thue_morse(6))
    got = work.encode(text)
    monkeypatch.undo()
    assert got == bpe.Replay.of_json(open(P.path("byte_bpe_50k.json"), "rb").read(), bpe.SPACED).encode(text)


def test_added_tokens_are_read_as_the_library_reads_them():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    work = bpe.Replay.of_json(open(P.path("byte_bpe_50k.json"), "rb").read(), bpe.SPACED)
    texts = ["a  <|endoftext|>  b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endof", "text|> <|endoftext", "|>", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(x.encode()) for x in texts)])
    ids, edges = work.encode_rows(raw, offsets)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert work.decode(ids[edges[0] : edges[1]]) == texts[0].encode()
