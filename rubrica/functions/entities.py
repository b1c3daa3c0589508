"""Numeric entities of a text: percentages, years, amounts of money, grouped numbers, integers in context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a single digit as worth keeping, within 50 characters before or after it.
CONTEXT_WORDS = "score level stage phase tier grade category priority objective goal target pillar element step type class group domain dimension".split()
REACH = 50
# The patterns of the other kinds; the digits, spaces and word ends of Unicode (U) are looked for only in texts that hold more than ASCII.
PERCENTAGE = r"(\d+\.?\d*)\s*%"
YEAR = r"\b((?:19|20)\d{2})\b"
MONEY = r"(?i)(?:USD|\$|€|£|¥)\s*(\d[\d,]*\.?\d*)(?:\s*(?:million|billion|trillion|[MBT]))?"
GROUPED = r"\b(\d{1,3}(?:,\d{3})+)\b"
INTEGER = r"\b0*[1-9]\d+\b"


def _by_kind(text: Column, of) -> Column:
    """of(flags of patterns), in ASCII without U, which takes several times as long and finds the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), of("")).otherwise(of("(?U)"))


def _all(text: Column, pattern: str, group: int) -> Column:
    return _by_kind(text, lambda flags: F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group)))


def percentages(text: Column) -> Column:
    found = F.transform(_all(text, PERCENTAGE, 1), lambda x: F.concat(x, F.lit("%")))
    return F.when(F.contains(text, F.lit("%")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def years(text: Column, first: int = 1990, last: int = 2099) -> Column:
    return F.filter(_all(text, YEAR, 1), lambda y: y.cast("int").between(first, last))


def money(text: Column) -> Column:
    """The whole match, its case kept; a suffix letter needs no word end ("$5 by" gives "$5 b")."""
    return _all(text, MONEY, 0)


def grouped_numbers(text: Column) -> Column:
    found = _all(text, GROUPED, 1)
    return F.when(F.contains(text, F.lit(",")), found).when(text.isNotNull(), F.array().cast("array<string>"))


_LONE = r"(?=0*[1-9]\b)\b(?:(?<=(.{50}))|(?<=^(.{0,49})))(0*[1-9])(?=(.{0,50}))"  # 50 is REACH; what is around is looked at at such a digit only
_WORDS = "(?i)" + "|".join(CONTEXT_WORDS)
_OPEN, _CUT = "\ufdd0", "\ufdd1"  # noncharacters, which no text holds


def _small(text: Column) -> Column:
    """Lone digits from 1 to 9 next to a context word: every one is marked with what stands around it, and stays if a word is there."""

    def has_word(x: Column, flags: str) -> Column:
        if flags:
            return x.rlike(_WORDS)
        found = F.lit(False)
        for w in CONTEXT_WORDS:
            found = found | F.contains(x, F.lit(w))
        return found

    def of(flags: str) -> Column:
        source = text if flags else F.lower(text)  # lone digits are the same in lower case
        marked = F.split(F.regexp_replace(source, f"(?s){flags}{_LONE}", f"{_OPEN}$1$2$3$4{_CUT}$3{_OPEN}"), _OPEN)
        near = F.filter(marked, lambda x: x.contains(_CUT) & has_word(x, flags))
        return F.when(has_word(source, flags) & text.rlike(flags + r"\b0*[1-9]\b"), F.transform(near, lambda x: F.substring_index(x, _CUT, -1))).otherwise(F.array().cast("array<string>"))

    return _by_kind(text, of)


def integers(text: Column) -> Column:
    """Integers from 10 on, and 1 to 9 next to a context word; 0 never."""
    return F.concat(_all(text, INTEGER, 0), _small(text))


def entities(text: Column, first_year: int = 1990, last_year: int = 2099) -> Column:
    """All kinds as one set. A year out of range comes in again as an integer."""
    return F.array_distinct(F.concat(percentages(text), years(text, first_year, last_year), money(text), grouped_numbers(text), integers(text)))
