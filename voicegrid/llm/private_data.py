"""Personal data in whole texts, as column expressions only.

Each kind has a pattern that proposes spans, a check that confirms them (Luhn
for cards, mod-97 for account numbers, ranges for addresses and numbers) and
words that raise or lower the span's score where they stand in the text around
it.  Everything is one projection over the rows: no shuffle, no Python worker.

Patterns begin at the start of a run of their characters (or where the former
match ended) and take runs possessively, so that a long run is read once.
Starts come from the lengths of the pieces between matches, summed in two
levels of blocks, so that many matches in one text stay cheap.

Defined results: a null text counts as empty and has no spans; spans of one
kind never overlap, spans of two kinds may; other columns are kept, except that
a column with the result's name is replaced.  Spans are ordered by start, then
by kind as listed in ``KINDS``; starts and ends count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.session import compute_once

BASE = ("email", "ip", "card", "phone")
#: Spans of kinds that only the method adds need this score, in hundredths.
LEAST_ADDED = 60
BEFORE, AFTER = 48, 24
#: Upper and lower ASCII letters, for lower-casing that no locale changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """``pattern`` is linear in Java; ``plain`` says the same to an engine without look-around."""

    name: str
    pattern: str
    plain: str
    confirm: Callable[[Column, Column], Column]
    prior: int
    raised_by: tuple[str, ...]
    lowered_by: tuple[str, ...] = ()
    needs: str = ""


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right last digit."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of capitals and digits leaves 1 when divided by 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def add(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _ip(value: Column, _before: Column) -> Column:
    return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")


def _card(value: Column, _before: Column) -> Column:
    return _let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _phone(value: Column, _before: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def _iban(value: Column, _before: Column) -> Column:
    short = F.replace(value, F.lit(" "), F.lit(""))
    return _let(short, lambda x: F.when(F.length(x).between(15, 34), mod97(x)).otherwise(False))


def _social(value: Column, _before: Column) -> Column:
    return ~value.rlike(r"^(?:000|666|9)|-00-|0000$")


def _national(_value: Column, before: Column) -> Column:
    return ~before.rlike(r"\+[0-9][ ().0-9-]*$")


_LOCAL = "[A-Za-z0-9._%+-]"
_ALONE, _ENDED = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_IBAN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_SOCIAL = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_NATIONAL = "[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
KINDS = (
    Kind(
        "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        rf"{_LOCAL}+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda value, before: F.lit(True), 70,
        ("mail", "email", "contact", "write", "courriel", "correo"), ("git", "ssh", "package"), "@",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _ip, 60,
        ("ip", "address", "host", "server", "client", "adresse"), ("version", "release", "build", "section"), ".",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13,}", _card, 75,
        ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"), ("order", "isbn", "serial", "tracking"),
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 65,
        ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"), ("order", "serial", "version"), "+",
    ),
    Kind(
        "iban", _ALONE + _IBAN + _ENDED, rf"\b{_IBAN}\b", _iban, 85,
        ("iban", "account", "bank", "konto", "compte", "cuenta"), ("serial", "tracking"),
    ),
    Kind(
        "social", _ALONE + _SOCIAL + _ENDED, rf"\b{_SOCIAL}\b", _social, 35,
        ("ssn", "social", "security", "taxpayer"), ("order", "serial"), "-",
    ),
    Kind(
        "national", _ALONE + _NATIONAL + _ENDED, rf"\b{_NATIONAL}\b", _national, 35,
        ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"), ("order", "serial", "version"),
    ),
)
RAISED, LOWERED = 25, 25


def word_pattern(words: tuple[str, ...]) -> str:
    """Finds any of the words, lower-cased and whole."""
    return f"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"


def _starts(lengths: Column) -> Column:
    """For each number of an array the sum of those before it, in two levels of blocks."""

    def add(values: Column, begin: Column, count: Column) -> Column:
        return F.aggregate(F.slice(values, begin, count), F.lit(0).cast("long"), lambda total, x: total + x)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: add(lengths, b * BLOCK + 1, F.lit(BLOCK)),
    )

    def placed(sums: Column) -> Column:
        before = F.transform(sums, lambda _x, b: add(sums, F.lit(1), b))
        return _let(
            before,
            lambda at: F.transform(
                lengths,
                lambda _x, i: F.get(at, F.floor(i / BLOCK).cast("int")) + add(lengths, i - i % BLOCK + 1, i % BLOCK),
            ),
        )

    return _let(blocks, placed)


def _spans(text: Column, place: int, kind: Kind) -> Column:
    """Confirmed and scored spans of one kind."""

    def scored(start: Column, value: Column, before: Column, after: Column) -> Column:
        around = F.translate(F.concat(before, F.lit(" "), after), UPPER, LOWER)
        score = F.lit(kind.prior) + F.when(around.rlike(word_pattern(kind.raised_by)), RAISED).otherwise(0)
        if kind.lowered_by:
            score = score - F.when(around.rlike(word_pattern(kind.lowered_by)), LOWERED).otherwise(0)
        return F.struct(
            start.alias("start"), F.lit(place).alias("place"), (start + F.length(value)).alias("end"), F.lit(kind.name).alias("kind"),
            value.alias("text"), F.least(F.lit(100), score).alias("score"), kind.confirm(value, before).alias("sure"),
        )

    def located(values: Column) -> Column:
        pieces = F.split(text, kind.pattern, -1)

        def at(parts: Column) -> Column:
            lengths = F.zip_with(F.slice(parts, 1, F.size(values)), values, lambda p, v: (F.length(p) + F.length(v)).cast("long"))
            return _let(
                _let(lengths, _starts),
                lambda starts: F.transform(
                    values,
                    lambda value, i: scored(
                        F.get(starts, i) + F.length(F.get(parts, i)), value,
                        F.right(F.get(parts, i), F.lit(BEFORE)), F.left(F.get(parts, i + 1), F.lit(AFTER)),
                    ),
                ),
            )

        found = F.filter(_let(pieces, at), lambda s: s["sure"])
        if kind.name not in BASE:
            found = F.filter(found, lambda s: s["score"] >= LEAST_ADDED)
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"),
                s["text"].alias("text"), (s["score"] / 100).alias("score"),
            ),
        )

    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.needs:
        values = F.when(F.contains(text, F.lit(kind.needs)), values)
    return _let(values, lambda v: F.when(F.size(v) > 0, located(v)))


def find_private(docs: DataFrame, text_col: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with ``name``: an array of (start, place, end, kind, text, score) for each text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    nothing = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string,text:string,score:double>>")
    each = [F.coalesce(_spans(text, place, kind), nothing) for place, kind in enumerate(KINDS)]
    return compute_once(docs, name, F.array_sort(F.concat(*each)))
