"""Command line: analyze, batch, validate, export, summary."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline, providers
from .common import staged
from .operators import quality, scores
from .operators.validate import file_report, folder_summary
from .settings import Settings
from .sources import analyses, pages, sinks


log = logging.getLogger("rubrica")


def _session() -> SparkSession:
    return SparkSession.builder.appName("rubrica").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _process(spark: SparkSession, documents: DataFrame, args: argparse.Namespace) -> int:
    s = Settings.load(args.config, **({"domain": args.domain} if args.domain else {})) if args.config else Settings(domain=args.domain or "cancer")
    rubric = args.rubric or s.rubric_path
    if not rubric:
        sys.exit("a rubric file is needed: --rubric, or rubric_path in the settings")
    docs = documents.withColumn("doc_id", F.col("path"))
    found = staged(pages.extract(docs.select("doc_id", "content"), confidence=s.ingestion.text_confidence), "pages")  # read and parsed once
    embedder = providers.SentenceEmbedder() if args.embed else None
    keep = sinks.Checkpoint(spark, s.checkpoint_dir, s.digest()) if s.checkpoints and s.checkpoint_dir else None
    out = pipeline.process(found.filter("error IS NULL"), analyses.rubric_entries(spark, rubric), providers.ChatEndpoint(model=s.generation.model_name, max_tokens=s.generation.max_tokens), embedder, s, keep)
    made = out["analyses"].join(docs.select("doc_id", "country", "year"), "doc_id")
    to = args.output_dir or s.output_dir or "."
    log.info("settings %s, writing to %s", s.digest(), to)
    sinks.write_json(sinks.as_json(made), to)
    reports = quality.report_json(out["assessed"]).join(docs.select("doc_id", "country", "year"), "doc_id")
    sinks.write_json(reports.select(sinks.file_name("country", "year", "_quality.json").alias("filename"), "json"), to)
    sinks.write_text(spark, f"{to}/settings.json", s.as_json())
    bad = found.filter("error IS NOT NULL").select("doc_id", "error")
    for r in bad.toLocalIterator():
        log.warning("%s: %s", r.doc_id, r.error)
    n = out["assessed"].groupBy("doc_id").agg(F.bool_or(F.col("error").isNull()).alias("fine")).agg(F.count(F.lit(1)).alias("all"), F.count_if("fine").alias("fine")).first()
    unreadable = bad.count()
    print(f"analysed {n['all']}, of these {n.fine} with a usable reply; unreadable {unreadable}")
    return int(unreadable > 0)


def analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = spark.read.format("binaryFile").load(args.pdf).select("path", F.lit(args.country).alias("country"), F.lit(args.year).alias("year"), "content")
    return _process(spark, docs, args)


def batch(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = analyses.documents(spark, args.input_dir)
    if docs.isEmpty():
        sys.exit(f"no PDF file in {args.input_dir}")
    return _process(spark, docs, args)


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    found = file_report(analyses.files(spark, args.folder), args.domain).cache()
    if not args.quiet:
        for r in found.orderBy("filename").select("filename", "is_valid", "total_categories", "expected_categories", F.slice("missing_categories", 1, 5).alias("first"), F.size("missing_categories").alias("n")).toLocalIterator():
            print(f"{r.filename}: {'COMPLETE' if r.is_valid else 'INCOMPLETE'} ({r.total_categories}/{r.expected_categories})")
            for c in r.first:
                print(f"  missing: {c}")
            if r.n > len(r.first):
                print(f"  and {r.n - len(r.first)} more")
    total = folder_summary(found).first()
    print(f"{total.n_complete}/{total.n_files} complete")
    if args.output:
        sinks.write_report(found.orderBy("filename"), args.output)
    return 0


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.commonwealth:
        print("rows: all {}, filtered {}".format(*sinks.export_both(spark, args.folder, args.output)))
    else:
        print("rows:", sinks.export_csv(spark, args.folder, f"{args.output}/analyses.csv"))
    found = analyses.files(spark, args.folder)
    log.info("%d countries", sinks.countries(analyses.entries(found)))
    for r in analyses.unreadable(found).toLocalIterator():
        log.warning("skipped %s: %s", r.filename, r.error)
    return 0


def summary(spark: SparkSession, args: argparse.Namespace) -> int:
    facts = analyses.facts(analyses.entries(analyses.files(spark, args.folder))).cache()
    plan = ("filename",)
    total = scores.summary(facts, args.domain, plan).first()
    if not total.total_plans:
        print("no data found")
        return 1
    ends = scores.top_and_bottom(facts, args.domain).orderBy("list", "rank").collect()  # six rows
    medians = scores.section_medians(facts, args.domain).orderBy("rank").collect()  # one row per section
    own = lambda name: [{"section": r.section, "median": round(r.median, 2)} for r in ends if r.list == name]
    stats = {
        "total_plans": total.total_plans, "median_overall": round(total.median_overall, 2), "mean_overall": round(total.mean_overall, 2), "highest_sections": own("highest"), "lowest_sections": own("lowest"), "section_medians": {r.section: round(r.median, 2) for r in medians},
    }
    text = json.dumps(stats, indent=2, ensure_ascii=False)
    print(text)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rubrica", description=__doc__)
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--log-file", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *needed: str, domain: str | None = "cancer", **more) -> None:
        c = sub.add_parser(f.__name__)
        c.set_defaults(run=f)
        for name in needed:
            c.add_argument(f"--{name}", required=True)
        c.add_argument("--domain", default=domain, choices=["cancer", "cvd"])
        for name, how in more.items():
            c.add_argument(f"--{name.replace('_', '-')}", **how)

    one, flag = {"default": ""}, {"action": "store_true"}
    command(analyze, "pdf", "country", "year", domain=None, output_dir=one, config=one, rubric=one, embed=flag)
    command(batch, "input-dir", domain=None, output_dir=one, config=one, rubric=one, embed=flag)
    command(validate, "folder", output=one, quiet=flag)
    command(export, "folder", "output", commonwealth=flag)
    command(summary, "folder", output=one)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, filename=args.log_file, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return args.run(_session(), args)


if __name__ == "__main__":
    sys.exit(main())
