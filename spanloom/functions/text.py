"""Scalar string functions as Column expressions."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Katakana U+30A1..U+30F6 and the hiragana 0x60 below them.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))

#: Characters that take two columns of a terminal: CJK, kana, hangul and full-width forms.
WIDE = "[\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}]"

#: Named character references that are decoded inside the JVM; a text with any other reference goes through a vectorised
#: function.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "hellip": "…", "amp": "&"}


def null_marker(c: Column) -> Column:
    """The missing-feature marker * and null as the empty string."""
    return F.when(c == "*", "").otherwise(F.coalesce(c, F.lit("")))


def to_hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def squeeze(c: Column, blank: str = "(?U)\\s") -> Column:
    """White space (Unicode's, unless a pattern is given) collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, f"{blank}+", " "))


def normalize(c: Column) -> Column:
    """The form in which names and meanings compare: squeezed and lower case."""
    return F.lower(squeeze(c))


def jlpt_level(c: Column) -> Column:
    """N5 is 5; what is no number after its leading non-digits is 0."""
    digits = F.regexp_replace(c, "^[^0-9]+", "")
    return F.when(digits.rlike("^[0-9]+$"), F.coalesce(digits.try_cast("int"), F.lit(0))).otherwise(0)


def display_width(c: Column) -> Column:
    """Terminal columns: wide characters count twice."""
    return F.char_length(c) + F.regexp_count(c, F.lit(WIDE))


def title(c: Column) -> Column:
    """A title without its final parenthesised group."""
    return F.trim(F.regexp_replace(c, "\\s*\\([^()]*\\)\\s*$", ""))


def slug(c: Column, prefix: str = "") -> Column:
    """Lower-case id of letters, digits, _ and -; an empty one is an error."""
    body = F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", ""))
    return F.when(body == "", F.raise_error(F.concat(F.lit("no id in "), c))).otherwise(F.concat(F.lit(prefix), body))


def level(c: Column) -> Column:
    """JLPT N3, N3 or 3 as N3; anything else is empty."""
    digit = F.regexp_extract(F.upper(F.trim(c)), "^(?:JLPT\\s*)?N?([1-5])$", 1)
    return F.when(digit == "", "").otherwise(F.concat(F.lit("N"), digit))


_NATIVE = f"&(?:{'|'.join(ENTITIES)});"


def unescape_named(c: Column) -> Column:
    """The references of ENTITIES decoded, one name after the other; others stay, as do those without their semicolon."""
    for name, value in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return c


def unescape(c: Column) -> Column:
    """Character references decoded, once each: named and numeric ones, as HTML defines them."""

    @F.pandas_udf("string")
    def other(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    rare = F.regexp_replace(c, _NATIVE, "").rlike("&[#A-Za-z]") | c.rlike("&amp;[#A-Za-z]")
    return F.when(rare, other(F.when(rare, c))).otherwise(unescape_named(c))


def plain_text(c: Column, decode: Callable[[Column], Column] = unescape, blank: str = "(?U)\\s") -> Column:
    """Markup to text: scripts, styles and tags to spaces, character references decoded, white space squeezed."""
    out = F.regexp_replace(c, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(decode(F.regexp_replace(out, "<[^>]*>", " ")), blank)


#: Headings that are no forms, labels before forms, and what is said about the sound of a form.
HEADINGS = "(?i)^(?:examples?|exceptions?|conjugations?|negative):?$"
LABELS = "(?i)^(?:past form|negative|polite|casual|formal):\\s*"
SOUND = "(?i),\\s*pronounced\\b.*$"


def structure_lines(c: Column) -> Column:
    """Forms in a structure field in HTML, in order and distinct; null has none.

    Line breaks end lines; lines that begin with a superscript go, as do deleted, superscripted, ruby and linked parts,
    headings and footnotes; of a line stays what follows its label and its last arrow.
    """
    text = F.regexp_replace(F.translate(c, "\u3000\u200b", " "), "(?i)<\\s*/?\\s*br\\s*/?\\s*>", "\n")
    raw = F.filter(F.split(text, "\r?\n"), lambda x: ~x.rlike("(?i)^\\s*<sup\\b"))
    whole = F.array_join(raw, "\n")
    for tag in ("del", "sup", "rt", "a"):
        whole = F.regexp_replace(whole, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "")
    whole = unescape(F.regexp_replace(whole, "<[^>]+>", ""))

    def clean(x: Column) -> Column:
        line = F.rtrim(F.regexp_replace(squeeze(x), SOUND, ""))
        skip = line.rlike(HEADINGS) | line.rlike("^\\s*\\((?:\\*|[0-9]+)\\)")
        form = F.trim(F.regexp_replace(F.regexp_replace(line, LABELS, ""), "^.*[→￫]", ""))
        return F.when(skip, "").otherwise(form)

    return F.array_distinct(F.filter(F.transform(F.split(whole, "\r?\n"), clean), lambda x: x != ""))


def dot_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def span_length(start: Column, end: Column) -> Column:
    """Tokens of an inclusive span."""
    return end - start + 1


def sense_text(glosses: Column) -> Column:
    return F.array_join(glosses, "; ")
