"""Column functions on text: tokens, sentences, syllables, readability, coherence, token windows, page layout.

White space is what Unicode calls so and the four separators U+001C to U+001F; every function keeps a null null.
Counts are taken by one regular expression over the whole text, not by a lambda per word, so they stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"\s\x1c-\x1f\x85"
_BLANK = rf"(?U)[{_W}]+"


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Words between white space, in order."""
    return F.filter(F.split(text, _BLANK), lambda t: t != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U)[^{_W}]+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[{_W}]+|[{_W}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^{_W}]")


def sentences(text: Column, longer_than: int = 0) -> Column:
    """Stripped pieces between runs of . ! ? that have more than so many characters."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: F.char_length(s) > longer_than)


def count_sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U)[^.!?{_W}][^.!?]*"))


def syllables(text: Column) -> Column:
    """Estimated syllables of all words of a text: runs of vowels, but for a silent e at the end; a final -le after a consonant counts; one
    per word at least."""
    low = F.lower(text)
    of = lambda pattern: F.regexp_count(low, F.lit("(?U)" + pattern))
    start, end = rf"(?<![^{_W}])", rf"(?![^{_W}])"
    runs = of("[aeiouy]+")
    none = of(rf"{start}[^aeiouy{_W}]+{end}")
    silent = of(rf"{start}[^aeiouy{_W}]*[aeiouy][^{_W}]*[^aeiouy{_W}][aeiouy]*e{end}")  # ends in e, with another run before
    final_le = of(rf"[^aeiouy{_W}]le{end}")
    return runs + none - silent + final_le


def _rates(text: Column) -> Column:
    """struct of words per sentence and syllables per word; both null without a word or a sentence."""
    counts = F.struct(count_words(text).cast("double").alias("w"), count_sentences(text).cast("double").alias("s"), syllables(text).cast("double").alias("y"))
    return let(counts, lambda c: F.when((c["w"] > 0) & (c["s"] > 0), F.struct((c["w"] / c["s"]).alias("per_sentence"), (c["y"] / c["w"]).alias("per_word"))))


def _grade(r: Column) -> Column:
    return F.when(r.isNotNull(), F.greatest(F.lit(0.39) * r["per_sentence"] + F.lit(11.8) * r["per_word"] - F.lit(15.59), F.lit(0.0))).otherwise(0.0)


def _ease(r: Column) -> Column:
    return F.when(r.isNotNull(), F.greatest(F.least(F.lit(206.835) - F.lit(1.015) * r["per_sentence"] - F.lit(84.6) * r["per_word"], F.lit(100.0)), F.lit(0.0))).otherwise(0.0)


def grade_level(text: Column) -> Column:
    """Flesch-Kincaid grade level, 0 at least; 0 without a word or a sentence."""
    return F.when(text.isNotNull(), let(_rates(text), _grade))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease between 0 and 100; 0 without a word or a sentence."""
    return F.when(text.isNotNull(), let(_rates(text), _ease))


def _band(x: Column, best: tuple, outside: tuple) -> Column:
    return F.when(x.between(*best), 1.0).when((x < outside[0]) | (x > outside[1]), 0.3).otherwise(0.7)


def readability(text: Column) -> Column:
    """0 to 1: best at grade 12 to 16 and ease 30 to 60; 0 below ten words."""
    measured = let(_rates(text), lambda r: F.struct(_grade(r).alias("grade"), _ease(r).alias("ease")))
    both = let(measured, lambda m: (_band(m["grade"], (12, 16), (8, 22)) + _band(m["ease"], (30, 60), (10, 80))) / 2)
    return F.when(count_words(text) < 10, 0.0).when(text.isNotNull(), both)


def _mean_of_neighbours(items: Column, of) -> Column:
    """Mean of of(item, the next item). items: named once by the caller."""
    n = F.size(items)
    total = F.aggregate(F.zip_with(F.slice(items, F.lit(1), n - 1), F.slice(items, F.lit(2), n - 1), of), F.lit(0.0), lambda a, x: a + x)
    return total / (n - 1)


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def coherence(text: Column) -> Column:
    """0 to 1: twice the mean overlap of words between neighbouring sentences; 0.5 below twenty words or two sentences."""
    words = F.transform(sentences(F.lower(text), 10), lambda s: F.array_distinct(tokens(s)))
    score = let(words, lambda w: F.when(F.size(w) < 2, 0.5).otherwise(F.least(_mean_of_neighbours(w, _overlap) * 2, F.lit(1.0))))
    return F.when(count_words(text) < 20, 0.5).when(text.isNotNull(), score)


def coherence_of_vectors(vectors: Column) -> Column:
    """The same from unit vectors of the sentences: their mean dot product, from 0.1 to 0.8 spread over 0 to 1."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = let(vectors, lambda v: F.when(F.size(v) < 2, 0.5).otherwise(F.greatest(F.least((_mean_of_neighbours(v, dot) - 0.1) / 0.7, F.lit(1.0)), F.lit(0.0))))
    return F.when(vectors.isNotNull(), score)


def token_windows(text: Column, size: int = 50, stride: int = 25, cover_tail: bool = False) -> Column:
    """Windows of ``size`` tokens, every ``stride``; a text of fewer is one window, one without tokens none.

    The last full window may leave up to stride - 1 tokens uncovered; ``cover_tail`` adds a window that ends with the text.
    """

    def made(words: Column) -> Column:
        last = F.greatest(F.size(words) - size, F.lit(0))
        starts = F.sequence(F.lit(0), last, F.lit(stride))
        if cover_tail:
            starts = F.array_union(starts, F.array(last))
        windows = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(windows)

    return F.when(text.isNotNull(), let(tokens(text), made))


def truncated(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


#: Limits of what goes into a prompt: document, page, assessment.
DOCUMENT_LIMIT, DOCUMENT_MARK, PAGE_LIMIT, ASSESSMENT_LIMIT = 80_000, "\n\n[Document truncated]", 3_000, 2_000


def _line_html(line: Column) -> Column:
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    shouted = line.rlike(r"\p{IsUppercase}") & ~line.rlike(r"[\p{IsLowercase}\p{Lt}]") & (F.char_length(line) < 100)
    marks = F.char_length(F.regexp_extract(line, "^#+", 0))
    level = F.least(marks, F.lit(6)).cast("string")
    head = strip(F.regexp_replace(line, "^[# ]+", ""))
    header = F.concat(F.lit("<h"), level, F.lit(">"), head, F.lit("</h"), level, F.lit(">"))
    return (
        F.when(shouted, tag("h1", line))
        .when(marks > 0, header)
        .when(line.rlike(r"^[-•*] "), tag("li", F.substring(line, F.lit(3), F.char_length(line))))
        .when(line.rlike(r"^[1-5]\."), tag("li", line))
        .otherwise(tag("p", line))
    )


def to_html(text: Column) -> Column:
    """Lines as headings, list items or paragraphs; blank ones go."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.array_join(F.transform(lines, _line_html), "\n")


def has_tables(html: Column, text: Column) -> Column:
    return F.contains(F.lower(html), F.lit("<table")) | F.contains(text, F.lit("│")) | F.contains(text, F.lit("+-"))


def has_figures(html: Column, text: Column) -> Column:
    low = F.lower(html)
    return F.contains(low, F.lit("<figure")) | F.contains(low, F.lit("<img")) | F.contains(F.lower(text), F.lit("[figure"))


def says_yes(reply: Column) -> Column:
    """Whether a reply to a yes/no question means yes."""
    said = F.upper(strip(reply))
    return F.when(F.startswith(said, F.lit("YES")), True).when(F.startswith(said, F.lit("NO")), False).otherwise(F.contains(said, F.lit("YES")) & ~F.contains(said, F.lit("NO")))


def unfenced(reply: Column) -> Column:
    """What stands in the first Markdown code fence, or all of it."""
    fence = r"```(?:json)?\s*([\s\S]*?)\s*```"
    return F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).otherwise(reply)


def safe_name(name: Column) -> Column:
    """For file names: word characters and - stay, others become _, none of which at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-]", "_"), r"^_+|_+\z", "")


def country_and_year(file_name: Column) -> tuple[Column, Column]:
    """Of "Some-Land_2021_2031.json": country "Some Land", year "2021-2031"; "Unknown" without a year."""
    base = F.replace(file_name, F.lit(".json"), F.lit(""))
    two, one = r"^(.+?)_(\d{4})_(\d{4})$", r"^(.+?)_(\d{4})$"
    part = lambda p, i: F.regexp_extract(base, p, i)
    plain = lambda x: F.translate(x, "_-", "  ")
    country = F.when(base.rlike(two), plain(part(two, 1))).when(base.rlike(one), plain(part(one, 1))).otherwise(plain(base))
    year = F.when(base.rlike(two), F.concat(part(two, 2), F.lit("-"), part(two, 3))).when(base.rlike(one), part(one, 2)).otherwise("Unknown")
    return country, year
