"""Column functions for cleaning and judging posts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the letters, digits and punctuation that cleaning keeps.
ALPHABET = r"가-힣a-zA-Z0-9\s.,!?%()~\-"
#: As above, with the letters of Western European languages.
LATIN = ALPHABET + "À-ÖØ-öø-ÿ"


def strip_tags(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, r"<[^>]+>", by)


def clean_text(text: Column, alphabet: str = ALPHABET, squeeze: bool = True) -> Column:
    """Null is empty; tags, then URLs, go; runs of four and more of a character become three; what the alphabet lacks becomes
    a space; runs of white space become one. (?U) makes \\s mean Unicode white space."""
    out = strip_tags(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?U)https?://\S+", " ")
    if squeeze:
        out = F.regexp_replace(out, r"(?s)(.)\1{3,}", "$1$1$1")
    out = F.regexp_replace(out, f"(?U)[^{alphabet}]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def only_marker(text: Column, markers: list[str]) -> Column:
    """Nothing but one of the marker words, brackets and white space aside."""
    return F.regexp_replace(text, r"(?U)[\s()\[\]{}<>《》〈〉]", "").isin(*markers)


def holds_any(text: Column, words: list[str]) -> Column:
    """True where any of the words is a substring; one alternation over quoted words."""
    if not words:
        return F.lit(False)
    return text.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words))


def short_and_holds(text: Column, words: list[str], most: int = 15) -> Column:
    return (F.length(text) <= most) & holds_any(text, words)


def low_signal(text: Column, markers: list[str], severe: list[str], mild: list[str]) -> Column:
    """Empty, a bare marker, a severe word anywhere, or a mild word in a text of at most 15 characters."""
    return (text == "") | only_marker(text, markers) | holds_any(text, severe) | short_and_holds(text, mild)


def join_text(*parts: Column, most: int = 500, by: str = ". ") -> Column:
    """Parts (null as empty) with ". " between, the first 500 characters."""
    return F.substring(F.concat_ws(by, *[F.coalesce(p, F.lit("")) for p in parts]), 1, most)


def named_id(source: str | Column, key: Column) -> Column:
    return F.concat_ws("_", F.lit(source) if isinstance(source, str) else source, key.cast("string"))


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative hits) / hits over the words of a text, 0 without hits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    hits = lambda own: F.size(F.filter(words, lambda w: w.isin(*own)))
    up, down = hits(positive), hits(negative)
    return F.coalesce(F.try_divide(up - down, up + down), F.lit(0.0))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
