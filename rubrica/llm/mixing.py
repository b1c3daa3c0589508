"""Mixing sources to target weights by entropy balancing.

Sources get a share of a token budget by weight; a target stops at ``cap`` times its source's size and the excess is
reshared by weight until none is above. Document rates w then minimise sum(w log w - w + 1) subject to each source's
token constraint sum(w * size) = target and w <= cap. The dual is convex with one multiplier per source, and the rates are
exponentially tilted: w = min(cap, exp(lambda * size / scale)). Newton iterations solve all sources at once over the
histogram of (source, size), which partial aggregation makes from narrow rows; a bracket guards them. Rates are rounded to
whole copies by error diffusion from the largest document to the smallest, within blocks of a bounded number of
documents (equal rows are one with a number, however many), so a source's words stray from the target by no more than half of a small document per block.

Every pass is distributed; the driver sees a few sums per iteration. A source with a third of all rows is one histogram
for the dual and many blocks for the rounding.

Defined cases: a null or empty text has size 0 and is taken once; a null source is a source of its own, last in order;
a source without words has target 0; repeated rows are separate documents; documents of equal size go by doc_id, then by a hash of their text; a very
long text counts whole; an empty table gives an empty table; further columns pass through ``mix`` untouched. Reruns agree, for nothing is drawn at random.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, small, staged, text_of

#: Documents that one task rounds; sources whose table may be broadcast.
BLOCK, BROADCAST_SOURCES = 10_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_SOURCES) else df


def _exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns agree to the last digit."""
    return F.sum(x.cast("decimal(38,8)")).cast("double")


def targets(rows: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """rows: source, size, many (equal ones). One row per source: k (its rank), source, source_size, n, target."""
    spark = rows.sparkSession
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.sum("many").alias("n")).orderBy(F.asc_nulls_last("source"))
    kind = rows.schema["source"].dataType.simpleString()
    ranked = sums.rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    all_ = staged(spark.createDataFrame(ranked, f"k long, source {kind}, source_size long, n long"), "mix-sources")
    all_ = all_.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("k") % len(weights) + 1).cast("int")))
    most = F.col("source_size") * float(cap)
    total = all_.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > most
        r = all_.agg(_exact_sum(F.when(over, most).otherwise(0.0)), _exact_sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if r[2] is None or r[2] == full or not r[1]:
            break
        full, level = r[2], (share * total - r[0]) / r[1]
    return all_.withColumn("target", F.least(most, F.col("weight") * F.lit(level))).drop("weight")


def solve(rows: DataFrame, sources: DataFrame, cap: float = 2.0, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """rows: k, size, many. The dual's solution: k, scale, lam."""
    histogram = rows.groupBy("k", "size").agg(F.sum("many").alias("docs")).filter("size > 0")
    histogram = staged(histogram.select("k", F.col("size").cast("double").alias("size"), "docs"), "mix-histogram")
    start = histogram.groupBy("k").agg((_exact_sum(F.col("docs") * F.col("size") * F.col("size")) / _exact_sum(F.col("docs") * F.col("size"))).alias("scale"), F.min("size").alias("least"))
    inf = float("inf")
    state = start.join(sources.select("k", "target", "source_size"), "k")
    # at the cap, every document is: the multiplier at which the smallest reaches it
    capped = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    done_at = F.log(F.lit(cap)) * F.col("scale") / F.col("least") * 1.0001
    state = staged(state.select("k", "scale", "target", F.when(capped, done_at).otherwise(0.0).alias("lam"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), capped.alias("done")), "mix-dual")
    bounded = small(state, BROADCAST_SOURCES)
    for _ in range(rounds):
        if not state.filter("not done").limit(1).count():
            break
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))
        mass = F.col("docs") * F.col("size")
        open_ = state.filter("not done").select("k", "scale", "lam")
        both = histogram.join(F.broadcast(open_) if bounded else open_, "k")
        slope = F.when(rate < cap, mass * F.col("size") / F.col("scale") * rate).otherwise(0.0)
        sums = both.groupBy("k").agg(_exact_sum(mass * rate).alias("have"), _exact_sum(slope).alias("slope"))
        gap = F.col("have") - F.col("target")
        near = F.abs(gap) <= F.greatest(F.col("target"), F.lit(1.0)) * tolerance
        lam = F.col("lam")
        step = state.join(F.broadcast(sums) if bounded else sums, "k", "left").withColumn("lo", F.when(gap < 0, lam).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, lam).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, lam - gap / F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - lam) <= 4 + 2 * F.abs(lam))
        middle = F.when(F.col("hi") == inf, 2 * F.greatest(F.col("lo"), F.lit(0.0)) + 1).when(F.col("lo") == -inf, 2 * F.least(F.col("hi"), F.lit(0.0)) - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        still = F.col("done") | F.coalesce(near, F.lit(True)) | (F.col("hi") - F.col("lo") <= 1e-13)
        state = staged(step.select("k", "scale", "target", F.when(still, lam).when(inside, newton).otherwise(middle).alias("lam"), "lo", "hi", still.alias("done")), "mix-dual")
    else:
        if state.filter("not done").limit(1).count():
            raise RuntimeError(f"the dual has not converged in {rounds} rounds")
    return state.select("k", "scale", "lam")


def diffuse(size: np.ndarray, rate: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of so many equal documents each, how many get the rate rounded up, so that running words stay nearest to running targets."""
    out, owed = np.zeros(len(size), np.int64), 0.0
    for i, (s, w, m) in enumerate(zip(size.tolist(), rate.tolist(), many.tolist())):
        part = w - math.floor(w)
        if part > 0 and s:
            owed += m * part * s
            out[i] = up = min(m, max(0, math.ceil(owed / s - 0.5)))
            owed -= up * s
    return out


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "doc_id", "th"], ascending=[False, True, True], kind="stable")
    return pdf.assign(up=diffuse(pdf["size"].to_numpy(), pdf.rate.to_numpy(), pdf.many.to_numpy()))


def shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for the documents that agree in doc_id, source and text: doc_id, source, size, th (hash of the text), many, source_size, target, rate, up:
    each is taken floor(rate) times, and the first ``up`` of them once more."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(text_of(text)).alias("th"))
    rows = staged(rows.groupBy("doc_id", "source", "size", "th").agg(F.count(F.lit(1)).alias("many")), "mix-rows")
    known = staged(targets(rows, weights, share, cap), "mix-targets")
    key = _bounded(known.withColumnRenamed("source", "its"))
    rows = rows.join(key, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    dual = _bounded(solve(rows.select("k", "size", "many"), known, cap))
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))
    rows = rows.join(dual, "k", "left").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "th"), F.ceil(F.col("n") / BLOCK)))
    kind = rows.schema["source"].dataType.simpleString()
    names = f"doc_id long, source {kind}, size long, th long, many long, source_size long, target double, rate double, k long, block long"
    return rows.select(*(c.split()[0] for c in names.split(", "))).groupBy("k", "block").applyInPandas(_round, f"{names}, up long").drop("k", "block")


def _times(df: DataFrame, number: str, row: str, crowded: bool) -> DataFrame:
    """Every row ``number`` times, numbered from 0 in ``row``. crowded: where some have very many, these are dealt over tasks in blocks."""
    part = f"{row}part"
    df = df.filter(F.col(number) > 0).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(number) - 1) / BLOCK))))
    if crowded:
        df = df.repartition(F.xxhash64(part, *(c for c, kind in df.dtypes if c != part and not kind.startswith(("map", "variant")))))
    return df.withColumn(row, F.explode(F.sequence(F.col(part) * BLOCK, F.least(F.col(number), (F.col(part) + 1) * BLOCK) - 1))).drop(part)


def rates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies, taken."""
    found = shares(docs, doc_id, text, source, **how)
    found = staged(found, "mix-shares")
    rows = _times(found, "many", "row", not small(found.filter(F.col("many") > BLOCK), 0))
    rows = rows.withColumn("copies", F.floor("rate") + (F.col("row") < F.col("up")).cast("long"))
    return rows.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs' rows, each as often as the mix takes it. Of rows that agree in id, source and text, those whose further columns have the smaller hashes come first."""
    from pyspark.sql import Window

    number, size, th, many, whole, up, d, s, row, rh, before, first, again = fresh(docs, *(f"__{c}" for c in "number size th many whole up d s row rh before first again".split()))
    found = shares(docs, doc_id, text, source, **how).select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(size), F.col("th").alias(th), F.col("many").alias(many), F.floor("rate").alias(whole), F.col("up").alias(up))
    found = staged(found, "mix-shares")
    keys = [d, s, size, th]
    left = docs.withColumn(th, F.xxhash64(text_of(text)))
    left = left.join(found.withColumnRenamed(th, f"{th}_"), left[doc_id].cast("long").eqNullSafe(F.col(d)) & left[source].eqNullSafe(F.col(s)) & (F.col(th) == F.col(f"{th}_"))).drop(f"{th}_")
    out = left.filter(F.col(many) == 1).withColumn(number, F.col(whole) + F.col(up)).select(*docs.columns, number)
    crowded = not small(found.filter(F.col(many) > 1), 0)
    if crowded:
        rows = left.filter(F.col(many) > 1)
        hashed = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))))
        own = F.first(F.struct(*docs.columns)).alias(row)
        rows = rows.withColumn(rh, hashed).groupBy(*keys, rh, whole, up).agg(own, F.count(F.lit(1)).alias(many))
        till = Window.partitionBy(*keys).orderBy(rh).rowsBetween(Window.unboundedPreceding, -1)  # over rows that differ
        rows = rows.withColumn(before, F.coalesce(F.sum(many).over(till), F.lit(0)))
        more = F.greatest(F.lit(0), F.least(F.col(many), F.col(up) - F.col(before)))
        rows = rows.withColumn(number, F.col(many) * F.col(whole) + more)
        out = out.unionByName(rows.select(*(F.col(row)[c].alias(c) for c in docs.columns), number))
    return _times(out, number, again, crowded).select(*docs.columns)
