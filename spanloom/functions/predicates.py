"""Token predicates as Column expressions. Missing features are empty strings, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a clause, and those among them that end a sentence.
CLAUSE_MARKS = ("、", ",", "，", "；", ";", "。", ".", "！", "!", "？", "?")
SENTENCE_MARKS = ("。", ".", "！", "!", "？", "?")

#: Geographic suffixes after which a proper noun is a new place.
PLACE_SUFFIXES = ("市", "町", "村", "区", "郡", "県", "都", "道", "府", "州")

#: Parts of speech (UniDic names).
PARTICLE, AUXILIARY, SUFFIX, PREFIX = "助詞", "助動詞", "接尾辞", "接頭辞"
MARK, SYMBOL, BLANK = "補助記号", "記号", "空白"
NOUN, VERB, ADJECTIVE, NOMINAL_ADJECTIVE = "名詞", "動詞", "形容詞", "形状詞"
PERIOD, OPENING, CLOSING = "句点", "括弧開", "括弧閉"
FUNCTION_WORDS = (PARTICLE, AUXILIARY)
EMPTY_WORDS = (PARTICLE, AUXILIARY, MARK, SYMBOL, BLANK, "")


def field_matches(expected: Column, actual: Column) -> Column:
    """An expected null matches everything."""
    return expected.isNull() | (expected == actual)


def clause_mark(surface: Column) -> Column:
    return surface.isin(*CLAUSE_MARKS)


def sentence_mark(surface: Column) -> Column:
    return surface.isin(*SENTENCE_MARKS)


def terminator(surface: Column, pos1: Column, pos2: Column) -> Column:
    """Ends a sentence: a full stop by its tags, or an ASCII ! or ?."""
    return ((pos1 == MARK) & (pos2 == PERIOD)) | surface.isin("!", "?")


def closing_bracket(pos2: Column) -> Column:
    return pos2 == CLOSING


#: ASCII punctuation and that of Japanese; opening brackets bind forward and don't count.
PUNCTUATION = tuple(c for c in (*map(chr, range(0x21, 0x7F)), *"、。・…‥“”※") if not (c.isascii() and c.isalnum()) and c not in "([{")


def punctuation(surface: Column) -> Column:
    """One punctuation character by surface."""
    return surface.isin(*PUNCTUATION)


def stem(pos1: Column, conj_form: Column) -> Column:
    """A verb or adjective form that a second predicate can follow."""
    return pos1.isin(VERB, ADJECTIVE) & (conj_form.startswith("連用形") | conj_form.startswith("語幹"))


def hosts_noun(surface: Column, pos1: Column, pos2: Column, pos3: Column) -> Column:
    """Whether a noun after this token continues its compound."""
    nominal = F.when(pos1 == NOUN, ~pos3.contains("副詞可能")).when(pos1 == SUFFIX, pos2 == "名詞的").otherwise(False)
    return F.when(surface == "・", True).when(punctuation(surface), False).otherwise(nominal)


def focus_particle(surface: Column, pos2: Column) -> Column:
    return (pos2 == "係助詞") & surface.isin("は", "も")


def te_form(surface: Column, pos1: Column, pos2: Column) -> Column:
    return ((pos2 == "接続助詞") | (pos1 == AUXILIARY)) & surface.isin("て", "で")


def function_word(pos1: Column) -> Column:
    return pos1.isin(*FUNCTION_WORDS)


def content_word(pos1: Column) -> Column:
    return ~pos1.isin(*EMPTY_WORDS)


#: Parts of speech whose members are a closed list, all or some of them.
CLOSED_CLASSES = ("助動詞", "形状詞", "形容詞")


def closed_class(pos1: Column, pos2: Column) -> Column:
    """Members of the inventory: auxiliaries, stems used as auxiliaries, and adjectives that can be auxiliaries."""
    return (pos1 == AUXILIARY) | ((pos1 == NOMINAL_ADJECTIVE) & (pos2 == "助動詞語幹")) | ((pos1 == ADJECTIVE) & (pos2 == "非自立可能"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def same_sense_or_rule(a: Column, b: Column) -> Column:
    """Same rule, or the same sense; a null sense equals nothing."""
    return (a["rule_id"] == b["rule_id"]) | F.coalesce(a["sense_id"] == b["sense_id"], F.lit(False))


def reading_matches(readings: Column, reading: Column) -> Column:
    return (reading == "") | F.array_contains(readings, reading)


#: Fill colours of tokens by part of speech.
COLOURS = {"名詞": "#D6EAF8", "動詞": "#D5F5E3", "助詞": "#FDEBD0", "助動詞": "#FEF9E7", "形容詞": "#E8DAEF", "副詞": "#FDEDEC", "代名詞": "#D6EAF8"}
OTHER_COLOUR = "#F2F3F4"


def pos_color(pos1: Column) -> Column:
    """Fill colour of a token by its part of speech."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), pos1), F.lit(OTHER_COLOUR))


def blank(text: Column) -> Column:
    return text.rlike("(?U)^\\s*$")
