"""Sentences and phrases (bunsetsu) of token rows, as gaps and islands."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .ordered import Batch

#: Why a token opens a phrase (True) or joins the one before it (False).
REASONS = {
    "sentence start": True,
    "after a prefix or an opening bracket": False,
    "opening bracket": True,
    "punctuation": False,
    "particle": False,
    "auxiliary": False,
    "suffix": False,
    "mark": False,
    "place name after a place suffix": True,
    "noun continues a compound": False,
    "noun": True,
    "auxiliary stem after a predicate": False,
    "auxiliary stem": True,
    "nominal adjective continues a compound": False,
    "nominal adjective": True,
    "light verb after a verbal noun": False,
    "dependent predicate after a te form": False,
    "dependent predicate after a stem": False,
    "dependent predicate": True,
    "content word": True,
}


def sentences(tokens: DataFrame) -> DataFrame:
    """tokens with sentence_id, from 0 in each document.

    A sentence ends with a run that a terminator begins and that terminators and closing brackets go on.
    """
    by = Window.partitionBy("doc_id").orderBy("position")
    ends = P.terminator(F.col("surface"), F.col("pos1"), F.col("pos2"))
    closes = P.closing_bracket(F.col("pos2")) & ~ends
    # A closing bracket goes on with whatever stands before it: with a run if one is there.
    marked = tokens.withColumn("__end", ends).withColumn("__close", closes)
    in_run = F.last(F.when(~F.col("__close"), F.col("__end")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    start = (F.col("position") == 0) | (F.coalesce(in_run, F.lit(False)) & ~F.col("__end") & ~F.col("__close"))
    marked = marked.withColumn("__start", start.cast("int"))
    return marked.withColumn("sentence_id", (F.sum("__start").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("__end", "__close", "__start")


#: What the token after this one asks, as bits of one number.
HOSTS, BINDS, PLACE, PREDICATE, STEM, VERBAL = (1 << i for i in range(6))


def _traits() -> Column:
    c = F.col
    asked = {
        HOSTS: P.hosts_noun(c("surface"), c("pos1"), c("pos2"), c("pos3")),
        BINDS: (c("pos1") == P.PREFIX) | (c("pos2") == P.OPENING),
        PLACE: c("surface").isin(*P.PLACE_SUFFIXES),
        PREDICATE: c("pos1").isin(P.VERB, P.ADJECTIVE, P.AUXILIARY),
        STEM: P.stem(c("pos1"), c("conj_form")),
        VERBAL: c("pos3").contains("サ変"),
    }
    return reduce(lambda a, b: a + b, [F.when(yes, bit).otherwise(0) for bit, yes in asked.items()])


CLASSES = ("opening bracket", "punctuation", "particle", "auxiliary", "suffix", "mark", "name", "noun", "auxiliary stem", "nominal adjective", "dependent light verb", "light verb", "dependent predicate", "content word")


def _class(told: Callable = lambda name: name) -> Column:
    """What a token is to a decision: a reason, where it depends on nothing before, or the name of a group of them."""
    c = F.col
    opening, dependent = c("pos2") == P.OPENING, c("pos2") == "非自立可能"
    return (
        F.when(P.punctuation(c("surface")), F.when(opening, told("opening bracket")).otherwise(told("punctuation")))
        .when(c("pos1") == P.PARTICLE, told("particle"))
        .when(c("pos1") == P.AUXILIARY, told("auxiliary"))
        .when(c("pos1") == P.SUFFIX, told("suffix"))
        .when(c("pos1").isin(P.MARK, P.SYMBOL), F.when(opening, told("opening bracket")).otherwise(told("mark")))
        .when(c("pos1") == P.NOUN, F.when(c("pos2") == "固有名詞", told("name")).otherwise(told("noun")))
        .when(c("pos1") == P.NOMINAL_ADJECTIVE, F.when(c("pos2") == "助動詞語幹", told("auxiliary stem")).otherwise(told("nominal adjective")))
        .when((c("pos1") == P.VERB) & (c("base_form") == "為る"), F.when(dependent, told("dependent light verb")).otherwise(told("light verb")))
        .when(c("pos1").isin(P.VERB, P.ADJECTIVE) & dependent, told("dependent predicate"))
        .otherwise(told("content word"))
    )


def _reason() -> Column:
    """The decision about a token, in order of precedence: from its class and the traits of the token before it."""
    kind, before = F.col("__class"), lambda bit: F.col("__before").bitwiseAND(bit) != 0
    dependent = F.when(F.col("__te"), "dependent predicate after a te form").when(before(STEM), "dependent predicate after a stem").otherwise("dependent predicate")
    noun = F.when(before(HOSTS), "noun continues a compound").otherwise("noun")
    return (
        F.when(F.col("__first"), "sentence start")
        .when(before(BINDS), "after a prefix or an opening bracket")
        .when(kind == "noun", noun)
        .when(kind == "name", F.when(before(PLACE), "place name after a place suffix").otherwise(noun))
        .when(kind == "auxiliary stem", F.when(before(PREDICATE), "auxiliary stem after a predicate").otherwise(kind))
        .when(kind == "nominal adjective", F.when(before(HOSTS), "nominal adjective continues a compound").otherwise(kind))
        .when(kind.endswith("light verb") & before(VERBAL), "light verb after a verbal noun")
        .when(kind.startswith("dependent"), dependent)
        .when(kind == "light verb", "content word")
        .otherwise(kind)
    )


def decisions(tokens: DataFrame) -> DataFrame:
    """tokens with sentence_id, starts_new and reason: the trace of phrase splitting.

    The look-back for a te form skips focus particles and may cross a sentence start. What depends on one token is
    computed on its row, in steps: the code of one long cascade would be too long for the JVM to compile.
    """
    found = tokens if "sentence_id" in tokens.columns else sentences(tokens)
    by = Window.partitionBy("doc_id").orderBy("position")
    te = F.when(~P.focus_particle(F.col("surface"), F.col("pos2")), P.te_form(F.col("surface"), F.col("pos1"), F.col("pos2")))
    found = found.withColumns({"__traits": _traits(), "__class": _class(), "__is_te": te})
    chain = F.coalesce(F.last("__is_te", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    first = F.coalesce(F.lag("sentence_id").over(by) != F.col("sentence_id"), F.lit(True))
    found = found.withColumns({"__before": F.lag("__traits", 1, 0).over(by), "__te": chain, "__first": first})
    found = found.withColumn("reason", _reason())
    opens = F.col("reason").isin(*[r for r, new in REASONS.items() if new])
    return found.withColumn("starts_new", opens).drop("__traits", "__class", "__is_te", "__before", "__te", "__first")


def phrases(tokens: DataFrame) -> DataFrame:
    """tokens with sentence_id, bunsetsu_id (from 0 in each sentence) and the phrase's inclusive span.

    Sentences are runs of positions, so all is counted along the document: with the order that sentences() needs too,
    there is one sort for all windows.
    """
    found = decisions(tokens) if "starts_new" not in tokens.columns else tokens
    by = Window.partitionBy("doc_id").orderBy("position")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    first = F.coalesce(F.lag("sentence_id").over(by) != F.col("sentence_id"), F.lit(True))
    found = found.withColumns({"__first": first, "__opened": F.sum(F.col("starts_new").cast("int")).over(run)})
    found = found.withColumn("__before", F.when(F.col("__first"), F.col("__opened") - F.col("starts_new").cast("int")))
    found = found.withColumn("__at", F.when(F.col("__first") | F.col("starts_new"), F.col("position")))
    ends = F.coalesce(F.expr("lead(__at, 1) IGNORE NULLS").over(by) - 1, F.max("position").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = found.withColumns({"bunsetsu_id": (F.col("__opened") - F.last("__before", ignorenulls=True).over(run) - 1).cast("int"), "bunsetsu_start": F.max("__at").over(run), "bunsetsu_end": ends.cast("int")})
    return found.drop("__first", "__opened", "__before", "__at")


def spans(tokens: DataFrame) -> DataFrame:
    """One row for each phrase: doc_id, sentence_id, bunsetsu_id, token_start, token_end."""
    found = tokens if "bunsetsu_id" in tokens.columns else phrases(tokens)
    return found.groupBy("doc_id", "sentence_id", "bunsetsu_id").agg(F.min("position").alias("token_start"), F.max("position").alias("token_end"))


# ---------------------------------------------------------------------------------------------------
# The same in a pass over whole documents


def with_codes(tokens: DataFrame) -> DataFrame:
    """tokens with __traits and __shape, what phrases in a pass need of each: __shape has the class, and in bits above it
    whether the token ends a sentence, closes a bracket, and is a te form or not (neither for focus particles)."""
    ends = P.terminator(F.col("surface"), F.col("pos1"), F.col("pos2"))
    te = F.when(P.focus_particle(F.col("surface"), F.col("pos2")), 0).when(P.te_form(F.col("surface"), F.col("pos1"), F.col("pos2")), 2).otherwise(1)
    bits = F.when(ends, 1).otherwise(0) + F.when(P.closing_bracket(F.col("pos2")) & ~ends, 2).otherwise(0) + te * 4
    coded = tokens.withColumns({"__traits": _traits(), "__class": _class(lambda name: F.lit(CLASSES.index(name)))})
    return coded.withColumn("__shape", (F.col("__class") + bits * 16).cast("int")).drop("__class")


def codes_of(surface: str, pos1: str, pos2: str, pos3: str, conj_form: str, base_form: str) -> tuple[int, int]:
    """(__traits, __shape) of with_codes(), for one kind of token."""
    mark = surface in P.PUNCTUATION
    nominal = "副詞可能" not in pos3 if pos1 == P.NOUN else pos1 == P.SUFFIX and pos2 == "名詞的"
    asked = {
        HOSTS: surface == "・" or not mark and nominal,
        BINDS: pos1 == P.PREFIX or pos2 == P.OPENING,
        PLACE: surface in P.PLACE_SUFFIXES,
        PREDICATE: pos1 in (P.VERB, P.ADJECTIVE, P.AUXILIARY),
        STEM: pos1 in (P.VERB, P.ADJECTIVE) and conj_form.startswith(("連用形", "語幹")),
        VERBAL: "サ変" in pos3,
    }
    dependent, opening = pos2 == "非自立可能", "opening bracket" if pos2 == P.OPENING else None
    if mark:
        name = opening or "punctuation"
    elif pos1 in (P.PARTICLE, P.AUXILIARY, P.SUFFIX):
        name = {P.PARTICLE: "particle", P.AUXILIARY: "auxiliary", P.SUFFIX: "suffix"}[pos1]
    elif pos1 in (P.MARK, P.SYMBOL):
        name = opening or "mark"
    elif pos1 == P.NOUN:
        name = "name" if pos2 == "固有名詞" else "noun"
    elif pos1 == P.NOMINAL_ADJECTIVE:
        name = "auxiliary stem" if pos2 == "助動詞語幹" else "nominal adjective"
    elif pos1 == P.VERB and base_form == "為る":
        name = "dependent light verb" if dependent else "light verb"
    else:
        name = "dependent predicate" if pos1 in (P.VERB, P.ADJECTIVE) and dependent else "content word"
    ends = pos1 == P.MARK and pos2 == P.PERIOD or surface in ("!", "?")
    focus = pos2 == "係助詞" and surface in ("は", "も")
    te = 0 if focus else 2 if (pos2 == "接続助詞" or pos1 == P.AUXILIARY) and surface in ("て", "で") else 1
    bits = ends + 2 * (pos2 == P.CLOSING and not ends) + 4 * te
    return sum(bit for bit, yes in asked.items() if yes), CLASSES.index(name) + 16 * bits


def opening_table(spark: SparkSession) -> np.ndarray:
    """Whether a token opens a phrase, by class, traits of the token before, te form before, and start of a sentence."""
    n = F.col("id")
    made = spark.range(len(CLASSES) * 64 * 4, numPartitions=1).select(
        "id",
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.floor(n / 256) + 1).cast("int")).alias("__class"),
        (F.floor(n / 4) % 64).cast("int").alias("__before"),
        (F.floor(n / 2) % 2 == 1).alias("__te"),
        (n % 2 == 1).alias("__first"),
    )
    rows = made.select("id", _reason().isin(*[r for r, new in REASONS.items() if new]).alias("opens")).collect()  # 3,584 rows
    out = np.zeros(len(rows), bool)
    for r in rows:
        out[r["id"]] = r["opens"]
    return out


class Phrases:
    """Sentences and phrases of the places of a batch; see phrases(). start and end are places."""

    NEEDS = ("__traits", "__shape")

    def __init__(self, batch: Batch, table: np.ndarray):
        places = batch.places
        traits, shape = places.spread(batch.code("traits"), 0), places.spread(batch.code("shape"), 4 << 4)
        end, close, te = (shape >> 4) & 1 == 1, (shape >> 5) & 1 == 1, shape >> 6
        edge = np.zeros(places.size, bool)
        edge[places.edges] = True
        opens = np.zeros(places.size, bool)
        opens[places.base] = True
        opens |= end[places.last(~close, before=True)] & ~end & ~close & ~edge
        count = np.cumsum(opens)
        self.sentence = count - count[self._base(places)]
        after_te = te[places.last(te != 0, before=True)] == 2
        before = np.concatenate([[0], traits[:-1]])
        new = table[(shape & 15) * 256 + before * 4 + after_te * 2 + opens] | edge
        self.opens_sentence = opens
        self.start = places.last(new)
        at = np.arange(places.size)
        following = np.minimum.accumulate(np.where(new, at, places.size)[::-1])[::-1]
        self.end = np.append(following[1:], places.size) - 1
        counted = np.cumsum(new)
        self.number = counted - counted[places.last(opens)]

    @staticmethod
    def _base(places) -> np.ndarray:
        out = np.zeros(places.size, np.int64)
        out[places.base] = places.base
        return np.maximum.accumulate(out)
