import json

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A few hundred documents with copies, near copies, shared passages, odd texts, nulls and repeated rows."""
    import random

    rng = random.Random(3)
    syllables = {"en": "the ing er on ation re".split(), "fr": "eau que ment é ouè an".split(), "de": "ung sch ein ü zu ter".split()}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(400)] for k, v in syllables.items()}

    def text(lang, n):
        out = []
        for i in range(n):
            out.append(rng.choice(words[lang]).capitalize() if rng.random() < 0.1 else rng.choice(words[lang]))
            if rng.random() < 0.1:
                out[-1] += rng.choice([".", ",", ".\n"])
        return " ".join(out).replace("\n ", "\n")

    passage = text("en", 60)
    rows, tongues = [], []
    for d in range(160):
        lang = rng.choice(["en", "en", "fr", "de"])
        body = text(lang, rng.choice([3, 12, 40, 120, 300]))
        kind = rng.random()
        if rows and kind < 0.1:
            other = rng.randrange(len(rows))
            body, lang = rows[other][1] or "", tongues[other]
        elif rows and kind < 0.3:
            other = rng.randrange(len(rows))
            base, lang = (rows[other][1] or "").split(" "), tongues[other]
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = rng.choice(words[lang])
            body = " ".join(base)
        elif kind < 0.4:
            body = text(lang, 20) + " " + passage + " " + text(lang, 20)
        if rng.random() < 0.5:
            body = "Site menu of all pages\n" + body
        tongues.append(lang)
        rows.append((d, body, lang if rng.random() < 0.9 else None, f"src{d % 3}", len(body)))
    odd = [None, "", " ", "\n\n", "x", "a b c d", "A B C D", "a  b\t c\n\nd", "123 456 !", "日本語 テキスト ñandú", "w" * 5000, "w " * 400, "<|endoftext|>", "é" * 700, " lead", "trail "]
    rows += [(200 + i, t, None, None if i % 2 else "src0", None if t is None else len(t)) for i, t in enumerate(odd)]
    rows += [(7, rows[7][1], "en", "src1", 1), (7, rows[7][1], "en", "src1", 1), (None, rows[3][1], "en", "src0", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(row):
    return json.loads(json.dumps(row.asDict(True), default=str))


__all__ = ["SCHEMA", "T", "plain"]
