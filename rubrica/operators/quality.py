"""Quality of analyses: schema, readability, coherence, coverage, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import Quality

LEAST_RESPONSE_WORDS, LEAST_REASONING_WORDS = 30, 20
REQUIRED = ["category", "response", "score", "scoring_reasoning", "response_page_citations", "scoring_reasoning_page_citations"]
# Placeholders that a reply must not hold, least lengths of a reply.
RESPONSE_PLACEHOLDERS = ["<Comprehensive analytical assessment", "[Provide details about", "<Your response here>"]
REASONING_PLACEHOLDERS = ["<Detailed justification", "[Explain the reasoning"]
LEAST_RESPONSE_CHARS, LEAST_REASONING_CHARS, HIGHEST_SCORE = 50, 30, 5


def _some(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda x: x.isNotNull())


def indicators_mentioned(response: Column, indicators: Column) -> Column:
    """Indicators of which at least half of the distinct terms occur, as substrings, in the response."""
    low = F.lower(response)

    def mentioned(indicator: Column) -> Column:
        terms = F.array_distinct(T.tokens(F.lower(indicator)))
        return F.size(F.filter(terms, lambda t: F.contains(low, t))) >= F.size(terms) * F.lit(0.5)

    return F.size(F.filter(indicators, mentioned))


def definition_share(response: Column, definition: Column) -> Column:
    """Share of the definition's terms of more than four characters that are tokens of the response."""
    terms = F.array_distinct(F.transform(F.filter(T.tokens(definition), lambda t: F.char_length(t) > 4), F.lower))
    return F.size(F.array_intersect(terms, T.tokens(F.lower(response)))) / F.greatest(F.size(terms), F.lit(1))


def coverage(response: Column, reasoning: Column, definition: Column, indicators: Column) -> tuple[Column, Column]:
    """(score, issues): from 1, less 0.3 for a short response and 0.2 each for a short reasoning, few indicators, few terms."""
    counts = F.struct(T.count_words(response).alias("rw"), T.count_words(reasoning).alias("sw"), F.size(indicators).alias("n"), indicators_mentioned(response, indicators).alias("seen"), ((definition != "") & (definition_share(response, definition) < 0.2)).alias("off"))

    def judged(c: Column) -> Column:
        short, brief, few = c["rw"] < LEAST_RESPONSE_WORDS, c["sw"] < LEAST_REASONING_WORDS, (c["n"] > 0) & (c["seen"] / F.greatest(c["n"], F.lit(1)) < 0.3)
        lost = lambda cond, x: F.when(cond, x).otherwise(0.0)
        score = F.greatest(F.lit(1.0) - lost(short, 0.3) - lost(brief, 0.2) - lost(few, 0.2) - lost(c["off"], 0.2), F.lit(0.0))
        issues = _some(
            F.when(short, F.format_string(f"Response too short (%d words, minimum {LEAST_RESPONSE_WORDS})", c["rw"])),
            F.when(brief, F.format_string(f"Reasoning too short (%d words, minimum {LEAST_REASONING_WORDS})", c["sw"])),
            F.when(few, F.format_string("Low indicator coverage (%d/%d indicators referenced)", c["seen"], c["n"])),
            F.when(c["off"], F.lit("Response does not address key definition terms")),
        )
        return F.struct(score.alias("score"), issues.alias("issues"))

    found = T.let(counts, judged)
    return found["score"], found["issues"]


def _kind(v: Column) -> Column:
    """Name of a variant's type as Python calls it."""
    known = {"VOID": "NoneType", "STRING": "str", "ARRAY": "list", "OBJECT": "dict", "BOOLEAN": "bool", "BIGINT": "int"}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.substring_index(F.schema_of_variant(v), "<", 1)), F.when(v.isNotNull(), "float"))


def repair(rows: DataFrame, entry: str = "entry", category: str = "category") -> DataFrame:
    """rows: a variant object (null: no object) and the category that it should have.

    Adds repaired (struct of the six fields), compliance (share of fields that are there in their type) and schema_issues. What is
    missing becomes "", 0 or an empty list; a score that is not a number becomes one if it reads as an integer, else 0, and is
    clamped to 0..5; citations keep what reads as an integer; texts and lists of another type become empty.
    """
    own = F.coalesce(F.try_variant_get(F.col(entry), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    made = T.let(own, lambda m: T.let(F.struct(*(F.map_contains_key(m, name).alias(f"has_{name}") for name in REQUIRED), *(F.try_element_at(m, F.lit(name)).alias(name) for name in REQUIRED)), lambda x: _repaired(x, F.col(category))))
    return rows.withColumn("repaired_", made).withColumns({"repaired": F.col("repaired_.repaired"), "compliance": F.col("repaired_.compliance"), "schema_issues": F.col("repaired_.issues")}).drop("repaired_")


def _repaired(entry: Column, category: Column) -> Column:
    """entry: struct of the required fields as variants, and has_ of each."""
    at = {name: entry[name] for name in REQUIRED}
    there = {name: entry[f"has_{name}"] for name in REQUIRED}
    wanted = {"category": "str", "response": "str", "scoring_reasoning": "str", "response_page_citations": "list", "scoring_reasoning_page_citations": "list"}
    kind = {name: _kind(at[name]) for name in REQUIRED}
    fits = {name: there[name] & (kind[name].isin("int", "float", "bool") if name == "score" else kind[name] == wanted[name]) for name in REQUIRED}
    fits = {name: F.coalesce(x, F.lit(False)) for name, x in fits.items()}
    said = lambda name: F.concat(F.lit(f"Type mismatch for {name}: expected {wanted.get(name, 'number')}, got "), F.coalesce(kind[name], F.lit("NoneType")))
    issues = _some(*[F.when(~there[name], f"Missing field: {name}").when(~fits[name], said(name)) for name in REQUIRED])
    get = lambda name, kind: F.try_variant_get(at[name], "$", kind)
    text = lambda name: F.when(fits[name], F.coalesce(get(name, "string"), F.lit(""))).otherwise("")
    number = F.when(fits["score"], F.when(kind["score"] == "bool", get("score", "boolean").cast("int").cast("double")).otherwise(get("score", "double")))
    read = F.regexp_extract(T.strip(get("score", "string")), r"^[+-]?\d+$", 0).try_cast("double")
    score = F.when(fits["score"], number).when(kind["score"] == "str", read)
    score = F.greatest(F.lit(0), F.least(F.lit(HIGHEST_SCORE), F.coalesce(score, F.lit(0.0)).cast("long"))).cast("int")

    def pages(name: str) -> Column:
        items = F.when(fits[name], get(name, "array<variant>"))
        whole = lambda x: F.when(_kind(x) == "str", F.regexp_extract(T.strip(F.try_variant_get(x, "$", "string")), r"^[+-]?\d+$", 0).try_cast("int")).when(_kind(x) == "bool", F.try_variant_get(x, "$", "boolean").cast("int")).when(_kind(x).isin("int", "float"), F.try_variant_get(x, "$", "double").try_cast("int"))
        return F.coalesce(F.filter(F.transform(items, whole), lambda x: x.isNotNull()), F.array().cast("array<int>"))

    made = F.struct(
        category.alias("category"), text("response").alias("response"), score.alias("score"), text("scoring_reasoning").alias("scoring_reasoning"), pages("response_page_citations").alias("response_page_citations"), pages("scoring_reasoning_page_citations").alias("scoring_reasoning_page_citations")
    )
    compliance = sum((x.cast("int") for x in fits.values()), F.lit(0)) / F.lit(float(len(REQUIRED)))
    return F.struct(made.alias("repaired"), compliance.alias("compliance"), issues.alias("issues"))


def acceptable(response: Column, score: Column, reasoning: Column) -> Column:
    """Whether a reply meets lengths and range and holds no placeholder."""
    clean = lambda x, marks: ~F.exists(F.array(*map(F.lit, marks)), lambda p: F.contains(x, p))
    fits = (F.char_length(response) >= LEAST_RESPONSE_CHARS) & (F.char_length(reasoning) >= LEAST_REASONING_CHARS) & score.between(0, HIGHEST_SCORE)
    return F.coalesce(fits & clean(response, RESPONSE_PLACEHOLDERS) & clean(reasoning, REASONING_PLACEHOLDERS), F.lit(False))


def assess(analyses: DataFrame, entries: DataFrame, settings: Quality | None = None, coherence: Column | None = None) -> DataFrame:
    """Adds readability, coherence, coverage, composite, passed and issues.

    analyses: category, response, scoring_reasoning, and compliance and schema_issues if they were repaired. entries: category,
    definition, indicators; categories without an entry are judged without it. coherence: another measure, e.g. of vectors.
    """
    s = settings or Quality()
    from ..common import bounded

    known = bounded(entries.select("category", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("indicators", F.array().cast("array<string>")).alias("indicators")))
    rows = analyses.join(known, "category", "left").withColumns({"definition": F.coalesce("definition", F.lit("")), "indicators": F.coalesce("indicators", F.array().cast("array<string>"))})
    response, reasoning = F.coalesce("response", F.lit("")), F.coalesce("scoring_reasoning", F.lit(""))
    both = F.concat(response, F.lit("\n"), reasoning)
    score, issues = coverage(response, reasoning, F.col("definition"), F.col("indicators"))
    if "compliance" not in analyses.columns:
        rows = rows.withColumns({"compliance": F.lit(1.0), "schema_issues": F.array().cast("array<string>")})
    rows = rows.withColumns({"readability": T.readability(both), "coherence": T.coherence(both) if coherence is None else coherence, "coverage": score, "issues": F.concat("schema_issues", issues)})
    composite = F.lit(s.readability_weight) * F.col("readability") + F.lit(s.coherence_weight) * F.col("coherence") + F.lit(s.coverage_weight) * F.col("coverage") + F.lit(s.schema_weight) * F.col("compliance")
    return rows.withColumn("composite", composite).withColumn("passed", F.round("composite", 9) >= s.composite_threshold).drop("definition", "indicators")


def report(assessed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: mean composite, pass rate, failed categories, number of issues."""
    return assessed.groupBy(key).agg(
        F.avg("composite").alias("overall_composite"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("category")))).alias("failed_categories"), F.sum(F.size("issues")).alias("total_issues")
    )


def report_json(assessed: DataFrame, key: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """key, json: each document's report as one JSON object, numbers with four decimals, its analyses in the order of the rubric."""
    r4 = lambda c: F.round(c, 4).alias(c)
    own = F.struct("category", r4("readability"), r4("coherence"), r4("coverage"), F.round("compliance", 4).alias("schema_compliance"), r4("composite"), "passed", "issues")
    scores = assessed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), own.alias("x")))).alias("all"))
    rows = report(assessed, key).join(scores, key)
    whole = F.struct(r4("overall_composite"), r4("pass_rate"), "failed_categories", "total_issues", F.transform("all", lambda a: a["x"]).alias("scores"))
    return rows.select(key, F.to_json(whole, {"pretty": "true"}).alias("json"))


def failed(assessed: DataFrame) -> DataFrame:
    return assessed.filter(~F.col("passed"))
