"""Column functions against plain definitions: literal edges, and random text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rubrica.functions import entities as E
from rubrica.functions import text as T

EDGES = [None, "", " ", "\x1c  a b\x1dc", "One two. Three!", "table apple the agree ie tree e le ale aisle rhythm", "..!?", "No end", "x" * 3001, "ÉCOLE SUPÉRIEURE\n# Head\n####### deep ##\n- item\n• dot\n* star\n3. third\n6. sixth\nabc\n\n   \n-no", "12.5% of 5,200 in 1999 and 2150, USD 5 Million, $5 by 2030, €1,000.50, 007 level 0", "score 4 v2 3", "1" + " x" * 26 + " stage", "stage " + "y" * 44 + " 7", "stage " + "y" * 45 + " 7", "classification 05"]


def column(spark, of, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in df.select("i", of(F.col("text")).alias("x")).orderBy("i").collect()]


def random_texts(n=300):
    rng = random.Random(5)
    parts = ["the", "Table", "agreeable.", "queue,", "12%", "3", "08", "level", "GOAL", "\n", "  ", "!", "?.", "$4", "1,234", "1999", "e", "le", "idle", "sky", "classes", "\t", "x9", "9x", "é", "stage5", "0", "10"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


TEXTS = EDGES + random_texts()


def of_syllables(text):
    total = 0
    for w in text.lower().split():
        runs = len(re.findall("[aeiouy]+", w))
        total += max(1, runs - (w.endswith("e") and runs > 1) + bool(re.search("[^aeiouy]le$", w)))
    return total


def of_sentences(text, longer=0):
    return [s.strip() for s in re.split("[.!?]+", text) if len(s.strip()) > longer]


def of_rates(text):
    w, s = len(text.split()), len(of_sentences(text))
    return (w / s, of_syllables(text) / w) if w and s else None


def of_grade(text):
    r = of_rates(text)
    return max(0.39 * r[0] + 11.8 * r[1] - 15.59, 0.0) if r else 0.0


def of_ease(text):
    r = of_rates(text)
    return max(min(206.835 - 1.015 * r[0] - 84.6 * r[1], 100.0), 0.0) if r else 0.0


def of_readability(text):
    if len(text.split()) < 10:
        return 0.0
    g, e = of_grade(text), of_ease(text)
    return ((1.0 if 12 <= g <= 16 else 0.3 if g < 8 or g > 22 else 0.7) + (1.0 if 30 <= e <= 60 else 0.3 if e < 10 or e > 80 else 0.7)) / 2


def of_coherence(text):
    own = [set(s.lower().split()) for s in of_sentences(text, 10)]
    if len(text.split()) < 20 or len(own) < 2:
        return 0.5
    pairs = [len(a & b) / min(len(a), len(b)) for a, b in zip(own, own[1:])]
    return min(2 * sum(pairs) / len(pairs), 1.0)


def of_windows(text):
    k = text.split()
    return [" ".join(k[i : i + 50]) for i in range(0, max(len(k) - 50, 0) + 1, 25)] if k else []


def of_entities(text):
    found = {f"{x}%" for x in re.findall(r"(\d+\.?\d*)\s*%", text)} | {y for y in re.findall(r"\b((?:19|20)\d{2})\b", text) if 1990 <= int(y) <= 2099}
    found |= {m[0].strip() for m in re.finditer(r"(?i)(?:USD|\$|€|£|¥)\s*(\d[\d,]*\.?\d*)\s*(?:million|billion|trillion|[MBT])?", text)} | set(re.findall(r"\b(\d{1,3}(?:,\d{3})+)\b", text))
    for m in re.finditer(r"\b\d+\b", text):
        around = text[max(0, m.start() - 50) : m.end() + 50].lower()
        if int(m[0]) >= 10 or int(m[0]) > 0 and any(w in around for w in E.CONTEXT_WORDS):
            found.add(m[0])
    return found


@pytest.mark.parametrize(("of", "want"), [(T.tokens, str.split), (T.count_words, lambda t: len(t.split())), (T.syllables, of_syllables), (T.count_sentences, lambda t: len(of_sentences(t))), (T.sentences, of_sentences), (T.token_windows, of_windows), (T.strip, str.strip), (T.is_blank, lambda t: not t.strip())], ids=lambda f: getattr(f, "__name__", ""))
def test_exactly(spark, of, want):
    assert column(spark, of, TEXTS) == [None if t is None else want(t) for t in TEXTS]


@pytest.mark.parametrize(("of", "want"), [(T.grade_level, of_grade), (T.reading_ease, of_ease), (T.readability, of_readability), (T.coherence, of_coherence)], ids=lambda f: f.__name__)
def test_nearly(spark, of, want):
    for t, x in zip(TEXTS, column(spark, of, TEXTS)):
        assert x is None if t is None else x == pytest.approx(want(t)), t


def test_entities(spark):
    assert [None if x is None else set(x) for x in column(spark, E.entities, TEXTS)] == [None if t is None else of_entities(t) for t in TEXTS]


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 74, 75, 76, 100])
def test_windows_of_every_length(spark, n):
    text = " ".join(map(str, range(n)))
    assert column(spark, T.token_windows, [text]) == [of_windows(text)]
    tail = column(spark, lambda c: T.token_windows(c, cover_tail=True), [text])[0]
    assert {w for x in tail for w in x.split()} == set(text.split())


def test_html(spark):
    got = column(spark, T.to_html, [EDGES[9]])[0]
    assert got.split("\n") == ["<h1>ÉCOLE SUPÉRIEURE</h1>", "<h1>Head</h1>", "<h6>deep ##</h6>", "<li>item</li>", "<li>dot</li>", "<li>star</li>", "<li>3. third</li>", "<p>6. sixth</p>", "<p>abc</p>", "<p>-no</p>"]


def test_replies_and_names(spark):
    assert column(spark, T.says_yes, ["YES.", " no", "NOT SURE", "I think yes", "yes and no", "well, yes or no", "", None]) == [True, False, False, True, True, False, False, None]
    assert column(spark, T.unfenced, ['a ```json\n{"x": 1}\n``` b', "```\n[]```", "{}", None]) == ['{"x": 1}', "[]", "{}", None]
    assert column(spark, T.safe_name, ["a/b (c)-d_", "__", "é ü"]) == ["a_b__c_-d", "", "é_ü"]
    names = ["Kenya_2019.json", "A_2021_2031.json", "Cook-Islands_2020.json", "Plan.json", "A_B_1999.json", "_2020.json"]
    assert column(spark, lambda c: F.array(*T.country_and_year(c)), names) == [["Kenya", "2019"], ["A", "2021-2031"], ["Cook Islands", "2020"], ["Plan", "Unknown"], ["A B", "1999"], [" 2020", "Unknown"]]


def test_flags_and_truncation(spark):
    df = spark.createDataFrame([("<TABLE>", "x"), ("<p>", "a │ b"), ("", "+-"), ("<img src>", ""), ("", "[Figure 1]"), ("", "")], "html string, text string")
    got = [tuple(r) for r in df.select(T.has_tables(F.col("html"), F.col("text")), T.has_figures(F.col("html"), F.col("text"))).collect()]
    assert got == [(True, False), (True, False), (True, False), (False, True), (False, True), (False, False)]
    assert column(spark, lambda c: T.truncated(c, 3), ["abc", "abcd", None]) == ["abc", "abc...", None]


def test_coherence_of_vectors(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [1.0, 0.0]],), ([[1.0, 0.0], [0.0, 1.0]],), ([[1.0, 0.0]],), ([[1.0, 0.0], [0.6, 0.8], [1.0, 0.0]],)], "v array<array<double>>")
    assert [r[0] for r in df.select(T.coherence_of_vectors(F.col("v"))).collect()] == pytest.approx([1.0, 0.0, 0.5, (0.6 - 0.1) / 0.7])
