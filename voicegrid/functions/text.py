"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voicegrid import fixed_values as fixed

_SPACES = f"[{fixed.SPACE_CLASS}]+"
_OUTER_SPACES = f"^[{fixed.SPACE_CLASS}]+|[{fixed.SPACE_CLASS}]+$"
_WORDS = f"[{fixed.WORD_CLASS}]+"
_VECTOR_TOKENS = f"[{fixed.WORD_CLASS}]{{2,}}"
_TOPIC_TOKENS = f"[{fixed.WORD_CLASS}][{fixed.WORD_CLASS}'-]*[{fixed.WORD_CLASS}]"
# White space and symbols alike: a run of both becomes one blank in one pass.
_TOPIC_BREAKS = f"[^{fixed.WORD_CLASS}'-]+"

# Everything but a-z, 0-9 and the apostrophe.  Listing the ranges is several
# times faster in Java than the negated class.
_NOT_ASPECT = r"[\x00-&(-/:-`{-\x{10FFFF}]+"

# Letters with a mark that Western European text uses, and their base letters.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def normalize_whitespace(text: Column | str) -> Column:
    """Null becomes ``""``; runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_column(text).cast("string"), F.lit("")), _SPACES, " "))


def strip(text: Column | str) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(_column(text).cast("string"), _OUTER_SPACES, "")


def is_blank(text: Column | str) -> Column:
    """True for null, empty and white-space-only values."""
    return normalize_whitespace(text) == ""


def fold(text: Column | str) -> Column:
    """Case-insensitive comparison key.

    Lower case plus the letters that fold further.  ``lower(upper(x))`` would
    not do: the optimizer reduces it to ``lower(x)``.
    """
    key = F.lower(_column(text))
    for letter, folded in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        key = F.replace(key, F.lit(letter), F.lit(folded))
    return key


def fold_key(text: Column | str) -> Column:
    """Fixed-size grouping key of the folded text, so shuffles never carry the text twice."""
    return F.unhex(F.sha2(fold(text), 256))


def collapse_repeated_punctuation(text: Column | str) -> Column:
    """Three or more of the same ``! ? . ,`` become one."""
    return F.regexp_replace(_column(text), r"([!?.,])\1{2,}", "$1")


def clean_for_classical_model(text: Column | str) -> Column:
    """Normalized lower-case text; negations and stop words stay."""
    return collapse_repeated_punctuation(F.lower(normalize_whitespace(text)))


def clean_for_transformer(text: Column | str) -> Column:
    """Normalized text with case kept."""
    return normalize_whitespace(text)


def clean_topic_text(text: Column | str) -> Column:
    """Lower-case text without URLs and without symbols other than ``'`` and ``-``."""
    lowered = F.lower(F.coalesce(_column(text).cast("string"), F.lit("")))
    without_urls = F.regexp_replace(lowered, fixed.URL_PATTERN, " ")
    return F.trim(F.regexp_replace(without_urls, _TOPIC_BREAKS, " "))


def tokenize_topic_text(text: Column | str) -> Column:
    """Topic tokens: two or more characters, inner ``'`` and ``-`` kept."""
    return _extract(clean_topic_text(text), _TOPIC_TOKENS)


def vector_tokens(text: Column | str) -> Column:
    """Runs of at least two word characters, the unit of both TF-IDF models."""
    return _extract(_column(text), _VECTOR_TOKENS)


def normalize_aspect_text(text: Column | str) -> Column:
    """Lower-case ASCII letters, digits and apostrophes, single blanks between."""
    lowered = F.lower(F.coalesce(_column(text).cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(lowered, _NOT_ASPECT, " "))


def aspect_match_text(text: Column | str) -> Column:
    """Text prepared for phrase search: every token, apostrophes included, has blanks around it."""
    lowered = F.lower(F.coalesce(_column(text).cast("string"), F.lit("")))
    spaced = F.replace(lowered, F.lit("'"), F.lit(" ' "))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, _NOT_ASPECT, " ")), F.lit(" "))


def word_count(text: Column | str) -> Column:
    """Number of runs of word characters."""
    return F.regexp_count(F.coalesce(_column(text).cast("string"), F.lit("")), F.lit(_WORDS)).cast("bigint")


def character_count(text: Column | str) -> Column:
    """Length without outer white space."""
    return F.length(strip(F.coalesce(_column(text).cast("string"), F.lit("")))).cast("bigint")


def raw_plain_tokens(text: Column | str) -> Column:
    """Folded ASCII words, still with trailing apostrophes."""
    return _extract(fold(F.coalesce(_column(text).cast("string"), F.lit(""))), "[A-Za-z][A-Za-z']+")


def trim_apostrophes(word: Column | str) -> Column:
    """Word without apostrophes at its ends."""
    return F.btrim(_column(word), F.lit("'"))


def plain_tokens(text: Column | str) -> Column:
    """Folded ASCII words for frequency tables, apostrophes trimmed at both ends."""
    return F.transform(raw_plain_tokens(text), trim_apostrophes)


def strip_accents(text: Column | str) -> Column:
    """Base letters in place of accented Latin letters (lower case)."""
    return F.translate(_column(text), _ACCENTED, _BASE)


def contains_ignoring_case(text: Column | str, needle: str) -> Column:
    """Literal substring test."""
    return F.contains(F.lower(F.coalesce(_column(text).cast("string"), F.lit(""))), F.lower(F.lit(needle)))
