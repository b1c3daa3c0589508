"""Small inputs that hold every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The quick brown fox jumps over the lazy dog, and then some more words follow. " * 2000
TEXTS = [
    None, "", " ", "\n\t \x0b\x0c\r", "a", "one two", "One  two", "onetwo", "a b c d e f g h", "A B C D E F G H", "naïve façade — 漢字   x", "é ÀÉ İstanbul ǆ", "line one\nline two\r\nline three\n\n", "<|endoftext|> and <|startoftext|>", "1234567890 12.5% 'S 'll don't", "word " * 300, LONG, "퟿￿\U0001f600 emoji 👩‍👩‍👧", "  leading and trailing  ", "tab\tseparated\tvalues",
]
CLASHING = ["size", "source_size", "target", "k", "norm", "sha", "id", "chars", "rate", "block", "copies", "shard", "length", "piece", "label", "score", "held_out", "h", "component_id", "kept", "bin"]


def rows() -> list[tuple]:
    out = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    out += [(100 + i, t, "en", "a", 1) for i, t in enumerate(TEXTS)]  # copies
    out += [(7, TEXTS[7], "en", "b", 1), (7, TEXTS[7], "en", "b", 1)]  # repeated rows
    return [*out, (None, "no id here", None, None, None), (None, None, None, None, None)]


def messy(spark, n_parts: int = 3):
    return spark.createDataFrame(rows(), DOCUMENT).repartition(n_parts)


def clashing(df):
    from pyspark.sql import functions as F

    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in have})


def empty(spark, schema: str = DOCUMENT):
    return spark.createDataFrame([], schema)


def got(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def duck(sql: str, sf_dir: str = SF) -> list[dict]:
    import duckdb

    with duckdb.connect() as con:
        for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        rel = con.sql(sql)
        return [dict(zip(rel.columns, r)) for r in rel.fetchall()]


def same_rows(left: list[dict], right: list[dict]) -> None:
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, left)) == sorted(map(key, right))
