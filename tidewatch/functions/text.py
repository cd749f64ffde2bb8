"""Text expressions.  All run inside the JVM on whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that make a complaint urgent
URGENT_WORDS = ["lawyer", "attorney", "lawsuit", "sue", "cfpb", "fraud", "identity theft", "stolen"]
# fixed value: the word whose mention gives the label away
LEAK_TERM = "churn"

# a run of letters, digits or underscore (any script), two or more long
TOKEN = r"[\p{L}\p{N}_]{2,}"
_SPACE = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), _SPACE, " "))


def normalize(c: Column | str) -> Column:
    """Lower case, anything but a-z becomes a space, runs of spaces collapse."""
    return squeeze(F.regexp_replace(F.lower(_col(c)), "[^a-z]", " "))


def mask_term(c: Column | str, term: str = LEAK_TERM, fix_punctuation: bool = True) -> Column:
    """Remove every word that starts with ``term`` (case-insensitive) and tidy the gap it leaves."""
    out = F.regexp_replace(_col(c), rf"(?iU)\b{term}\w*\b", "")
    out = F.regexp_replace(out, _SPACE, " ")
    if fix_punctuation:
        out = F.regexp_replace(out, r"(?U)\s+([.,])", "$1")
    return F.trim(out)


def drop_last_sentence(c: Column | str, term: str = LEAK_TERM) -> Column:
    """Drop the closing sentence and mask ``term``; empty when there is only one sentence."""
    trimmed = F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")
    sentences = F.filter(F.split(trimmed, r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    kept = F.array_join(F.slice(sentences, 1, F.greatest(F.size(sentences) - 1, F.lit(0))), " ")
    return F.when(F.size(sentences) <= 1, F.lit("")).otherwise(mask_term(kept, term, fix_punctuation=False))


def mentions(c: Column | str, term: str = LEAK_TERM) -> Column:
    return F.coalesce(F.contains(F.lower(_col(c)), F.lit(term.lower())), F.lit(False))


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated pieces; an empty text counts as one piece."""
    return F.size(F.split(F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", ""), _SPACE))


def is_urgent(c: Column | str, words: list[str] | None = None) -> Column:
    # word borders are ASCII ones: an accented letter ends a word
    pattern = r"(?i)(?<![a-z0-9_])(" + "|".join(words or URGENT_WORDS) + r")(?![a-z0-9_])"
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def truncate(c: Column | str, length: int, ellipsis: str = "") -> Column:
    column = _col(c)
    cut = F.substring(column, 1, length)
    if not ellipsis:
        return cut
    return F.when(F.length(column) > length, F.concat(cut, F.lit(ellipsis))).otherwise(column)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))


def ascii_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z]+"), F.lit(0))


def hash_slot(word: Column, dim: int) -> Column:
    """The word's 128-bit md5 value modulo ``dim``, computed from four 32-bit pieces."""
    digest = F.md5(word)
    total = None
    for piece in range(4):
        weight = pow(2, 32 * (3 - piece), dim)
        value = F.conv(F.substring(digest, 8 * piece + 1, 8), 16, 10).cast("long") % F.lit(dim)
        total = value * weight if total is None else total + value * weight
    return F.pmod(total, F.lit(dim)).cast("int")


def pseudonym(raw: Column | str, salt: str) -> Column:
    """Stable, salted visitor id: 16 hex digits; missing or empty input becomes 'unknown'."""
    value = _col(raw).cast("string")
    value = F.when(value.isNull() | (value == ""), F.lit("unknown")).otherwise(value)
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), 1, 16)
