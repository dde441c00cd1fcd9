"""Language identification: script ranges, per-word scores, Viterbi over the words of a text.

A word is a maximal run of letters and the marks that follow them. Its code points decide its script by fixed ranges, and the languages that
hold a share of their own training words in that script are its candidates, however rare they are among all. A word's score for a candidate is the mean
log probability of its hashed features (whole word, affixes and letter trigrams) under that language. Viterbi with
a penalty for each switch labels every word, so that a text falls into spans of one language each; the language
that labels most letters is the text's language and its share of the letters is the score.

The model is a table of FEATURES counts for each language, so it is bounded whatever the corpus; it is fitted on
about TRAIN_ROWS labelled rows, those with the smallest hashes of their ids. Only the hashed feature counts and
the script counts reach the driver.

Defined cases: a text that is null or has no letter is `und` with score 0 and has no spans; with no labelled row
every text is `und`; ties go to the language that sorts first; repeated rows are labelled alike; very long texts are
labelled whole, a block by itself; columns named lang_pred, score or spans give way to the results, all others stay;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import memory_for, unused

#: Documented bounds of the model and of its training sample.
FEATURES = 1 << 16
TRAIN_ROWS = 5_000
SWITCH = 6.0  # nats
LEAST_SHARE = 0.002  # of a language's training words, for it to be a candidate of their script
MEMO_WORDS = 300_000
BLOCK_CHARS = 3_000_000

#: First code point of each Unicode range and the script it holds.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_BEGINS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])


def _word_pattern(points: int) -> re.Pattern:
    """Letters (Unicode category L) with marks (M) after the first, among the first code points: numerals are none."""
    runs: dict[str, list[str]] = {"L": [], "M": []}
    for kind, found in runs.items():
        begin = None
        for point in range(points + 1):
            inside = point < points and unicodedata.category(chr(point))[0] == kind
            if inside and begin is None:
                begin = point
            elif not inside and begin is not None:
                found.append(f"\\U{begin:08x}-\\U{point - 1:08x}")
                begin = None
    letters, marks = "".join(runs["L"]), "".join(runs["M"])
    return re.compile(f"[{letters}][{letters}{marks}]*")


#: Of the basic plane, which is a table lookup for each character, and of all planes.
_BASIC, _WORD = _word_pattern(0x10000), _word_pattern(0x110000)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters and marks that begin with a letter."""
    return (_WORD if not text.isascii() and _BEYOND.search(text) else _BASIC).findall(text)


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    padded = f"<{word}>"
    found = {padded, padded[:4], padded[-4:], *[padded[i : i + 3] for i in range(len(padded) - 2)]}
    return [zlib.crc32(x.encode()) % FEATURES for x in found]


def script(word: str) -> int:
    """Script of a word: that of its first letter."""
    return int(_SCRIPT_OF[np.searchsorted(_BEGINS, ord(word[0]), side="right") - 1])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> dict:
    """A model from labelled rows of df; rows with a null text or label teach nothing."""
    import pyarrow as pa

    labelled = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    # The rows with the smallest hashes, found without sorting texts: first the threshold, then the rows below it.
    total = df.filter(F.col(f"`{lang}`").isNotNull()).count()
    share = min(1.0, rows / max(1, total))
    sample = labelled if share == 1.0 else labelled.filter((F.xxhash64(F.col("key")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) < share)
    columns = FEATURES + len(NAMES)

    def count(batches):
        memory_for("langid")
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for one, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in seen:
                    seen[name] = np.zeros(columns, dtype=np.int64)
                counts = seen[name]
                for w, n in Counter(words_of(one.lower())).items():
                    counts[FEATURES + script(w)] += n
                    for f in features(w):
                        counts[f] += n
        for name, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "feature", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, feature int, n long")
    # At most FEATURES + scripts rows for each language come back.
    table = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("feature").alias("f"), F.collect_list("n").alias("n")).collect()
    langs = sorted(r["lang"] for r in table)
    counts = np.zeros((len(langs), columns))
    for r in table:
        counts[langs.index(r["lang"]), r["f"]] = r["n"]
    smooth = counts[:, :FEATURES] + 0.2
    scripts = counts[:, FEATURES:]
    share_of = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    allowed = share_of >= LEAST_SHARE
    allowed[:, ~allowed.any(axis=0)] = True  # a script never seen leaves all languages
    return {"langs": langs, "logs": np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T.copy(), "allowed": allowed.T.copy()}


class Labeller:
    """Labels the words of texts; scores of words are kept in a bounded memo."""

    def __init__(self, model: dict, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.langs = model["langs"]
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), dtype=np.float32)

    def _score(self, words: list[str]) -> np.ndarray:
        logs, allowed = self.model["logs"], self.model["allowed"]
        rows = [features(w) for w in words]
        sizes = np.array([len(r) for r in rows])
        flat = logs[np.concatenate(rows) if rows else np.zeros(0, int)]
        sums = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) if rows else flat
        # A mean over features, weighted by letters up to 8, keeps long words from outvoting their neighbours.
        out = sums / sizes[:, None] * np.minimum([len(w) for w in words], 8)[:, None] / 2
        out[~allowed[[script(w) for w in words]]] = -200.0
        return out.astype(np.float32)

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.scores = {}, self.scores[:0]
        memo = self.memo
        new = list(set().union(*texts).difference(memo)) if texts else []
        begin = len(memo)
        memo.update(zip(new, range(begin, begin + len(new))))
        if new:
            made = [self._score([w.lower() for w in new[a : a + 50_000]]) for a in range(0, len(new), 50_000)]
            self.scores = np.concatenate([self.scores, *made])
        return [np.fromiter(map(memo.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the language index and the length in letters of every word."""
        words = [words_of(t) for t in texts]
        if not self.langs:
            return [(np.zeros(0, np.int16), np.zeros(0, np.int64)) for _ in texts]
        ids = self._ids(words)
        paths = viterbi([self.scores[i] for i in ids], self.switch)
        return [(p, np.fromiter(map(len, w), dtype=np.int64, count=len(w))) for p, w in zip(paths, words)]


def viterbi(emissions: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best state of each step for every sequence; all sequences advance together, step by step."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order], dtype=np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(emissions)
    steps = int(lengths[0]) if len(order) else 0
    if not steps:
        return out
    states = emissions[0].shape[1]
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # sequences with at least t steps
    # Rows in step-major order: step t of the j-th longest sequence stands at begin[t] + j.
    begin = np.concatenate([[0], np.cumsum(live)])
    flat = np.empty((int(begin[-1]), states), dtype=np.float32)
    for j, i in enumerate(order):
        flat[begin[: lengths[j]] + j] = emissions[i]
    back = np.empty((int(begin[-1]), states), dtype=np.int16)
    own = np.arange(states, dtype=np.int16)
    value = flat[: live[0]].copy()
    final = np.empty((len(order), states), dtype=np.float32)
    for t in range(1, steps):
        n = live[t]
        if n < len(value):
            final[n : len(value)] = value[n:]
            value = value[:n]
        best = value.argmax(axis=1)
        moved = value[np.arange(n), best][:, None] - np.float32(switch)
        stay = value >= moved
        back[begin[t] : begin[t + 1]] = np.where(stay, own, best[:, None].astype(np.int16))
        value = np.where(stay, value, moved) + flat[begin[t] : begin[t + 1]]
    final[: len(value)] = value
    state = final.argmax(axis=1).astype(np.int16)
    labels = np.empty(int(begin[-1]), dtype=np.int16)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        labels[begin[t] : begin[t + 1]] = state[:n]
        if t:
            state[:n] = back[begin[t] : begin[t + 1]][np.arange(n), state[:n]]
    for j, i in enumerate(order):
        out[i] = labels[begin[: lengths[j]] + j]
    return out


def verdict(labels: np.ndarray, letters: np.ndarray, langs: list[str]) -> tuple[str, float]:
    if not len(labels):
        return "und", 0.0
    weight = np.bincount(labels, weights=letters, minlength=len(langs))
    best = int(weight.argmax())
    return langs[best], float(weight[best] / weight.sum())


def _labeller(shared) -> Labeller:
    """One labeller in a Python worker, so that its memo lasts over tasks."""
    model, made = shared.value, memory_for("langid")
    if "labeller" not in made or made["labeller"].model is not model:
        made["labeller"] = Labeller(model)
    return made["labeller"]


def predict(df: DataFrame, model: dict, text: str = "text", spans: bool = False, keep: bool = True) -> DataFrame:
    """df with lang_pred and score, and with spans set also the spans of one language as [lang, first word, words].

    keep: whether Python workers remember the scores of words from one task to the next.
    """
    import pyarrow as pa

    from .bpe import blocks

    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES and the number of languages
    made = ["lang_pred", "score", *["spans"] * spans]
    rest = [c for c in df.columns if c not in made]
    base = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(unused("__in", rest)))
    schema = df.select(*[F.col(f"`{c}`") for c in rest]).schema.add("lang_pred", "string").add("score", "double")
    if spans:
        from pyspark.sql.types import _parse_datatype_string

        schema = schema.add("spans", _parse_datatype_string("array<struct<lang:string,first:int,words:int>>"))
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches):
        work = _labeller(shared)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(rest)).to_pylist()]
            for a, b in blocks(np.array([len(x) for x in texts]), BLOCK_CHARS):
                found = work.label(texts[a:b])
                rows = [verdict(*x, work.langs) for x in found]
                cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
                if spans:
                    cols.append(pa.array([_spans(x[0], work.langs) for x in found], span_type))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(rest))], *cols], names=[*rest, *made])
                del found, rows, cols
        if not keep:
            memory_for("")

    return base.mapInArrow(run, schema)


def _spans(labels: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(labels):
        return []
    edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [{"lang": langs[labels[a]], "first": a, "words": b - a} for a, b in zip(edges, edges[1:])]


def held_out(key: str = "doc_id"):
    """Whether a row belongs to the quarter of the ids that never trains."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


def trained_model(docs: DataFrame) -> dict:
    """The model of the queries: fitted on the rows that are not held out."""
    return fit(docs.filter(~held_out()))


def op6_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 6: the language of every document, learned from three quarters of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained_model(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
