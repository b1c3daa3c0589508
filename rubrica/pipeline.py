"""Documents end to end: pages, analyses by a generator, quality with bounded remediation, evidence pages, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, staged
from .operators import attribution, generation, quality, remediation, rubric, similarity
from .settings import Settings
from .sources import pages as P
from .sources import sinks


def prompts(documents: DataFrame, entries: DataFrame, settings: Settings, embedder=None) -> DataFrame:
    """documents: doc_id, full_text. One prompt for every document and entry of the rubric (of fixed size, so broadcast).

    The knowledge base is asked by vectors if there is an embedder, else by terms.
    """
    knowledge = rubric.knowledge_base(entries)
    asked = entries.select(F.col("category").alias("query"), F.col("category").alias("text"))
    if embedder is not None:
        knowledge = generation.embed(knowledge, embedder, "content", settings.attribution.embed_batch)
        asked = generation.embed(asked, embedder, "text", settings.attribution.embed_batch)
    knowledge = staged(knowledge, "knowledge")
    near = similarity.retrieve(asked, knowledge, settings.generation.context_documents)
    context = near.join(knowledge, "ord").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("all"))
    context = context.select(F.col("query").alias("category"), F.array_join(F.transform("all", lambda x: x["content"]), "\n\n").alias("knowledge"))
    each = entries.select("ordinal", "category").join(rubric.prompt_context(entries), "category").join(context, "category", "left")
    each = staged(each, "prompts")
    rows = documents.crossJoin(bounded(each, 10_000))
    prompt = generation.analysis_prompt(F.col("category"), F.col("context"), F.coalesce("knowledge", F.lit("")), F.col("full_text"), settings.domain)
    return rows.select("doc_id", "ordinal", "category", prompt.alias("prompt"))


def _assessed(rows: DataFrame, entries: DataFrame, settings: Settings) -> DataFrame:
    """Analyses repaired to the schema, then assessed; citations come later and count as empty lists."""
    none = F.array().cast("array<int>")
    entry = F.struct("category", "response", none.alias("response_page_citations"), "score", "scoring_reasoning", none.alias("scoring_reasoning_page_citations"))
    rows = quality.repair(rows.withColumn("entry", F.try_parse_json(F.to_json(entry, {"ignoreNullFields": "false"}))))
    rows = rows.withColumns({c: F.col(f"repaired.{c}") for c in ("response", "score", "scoring_reasoning")}).drop("entry", "repaired")
    return quality.assess(rows, entries, settings.quality)


def process(pages: DataFrame, entries: DataFrame, generator, embedder=None, settings: Settings | None = None, checkpoint: sinks.Checkpoint | None = None, voter=None) -> dict[str, DataFrame]:
    """pages: doc_id, page_number, text. All documents in one job: analyses (with citations), assessed, report, references.

    Votes on pages are taken only if a ``voter`` (a generator) is given; without, evidence is of medium or low confidence.
    What a model says is written before anything reads it twice; finished analyses in the checkpoint are not asked for again.
    """
    s = settings or Settings()
    asked = staged(prompts(P.full_text(pages), entries, s, embedder), "asked")
    made = staged(generation.analyse(asked if checkpoint is None else checkpoint.left(asked), generator, s.generation), "analyses")
    if checkpoint is not None:
        checkpoint.add(made)
        made = checkpoint.done().join(asked.select("doc_id", "category"), ["doc_id", "category"], "left_semi").select(*made.columns)

    def again(open_: DataFrame) -> DataFrame:
        rows = asked.join(open_.select("doc_id", "category"), ["doc_id", "category"], "left_semi")
        return _assessed(staged(generation.analyse(rows, generator, s.generation), "analyses"), entries, s)

    assessed = staged(remediation.remediate(_assessed(made, entries, s), again, s.quality), "assessed")
    out = {"assessed": assessed, "report": quality.report(assessed)}
    rows = assessed.select("doc_id", "ordinal", "category", "response", "score", "scoring_reasoning", "error")
    if s.page_references:
        refs = staged(attribution.extract(rows, pages, embedder, voter, s.attribution), "references")
        return out | {"references": refs, "analyses": attribution.cite(rows, refs)}
    none = F.array().cast("array<int>")
    return out | {"analyses": rows.withColumns({"response_page_citations": none, "scoring_reasoning_page_citations": none})}
