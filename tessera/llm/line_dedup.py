"""Line dedup: lines that many documents share go, one copy stays.

Lines are exploded with their positions, normalised and hashed; distinct
documents are counted per hash; lines over the threshold are dropped in every
document but one; the rest is reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, lower_ascii, materialise


def _lines(df: DataFrame, min_chars: int) -> DataFrame:
    """One row per countable line: document, row digest, position and a 128-bit key digest."""
    key = lower_ascii(F.btrim("__line", F.lit(SPACES)))
    return (
        df.select("__id", "__row", F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
        .select("__id", "__row", "__pos", key.alias("__key"))
        .filter(F.length("__key") >= min_chars)
        .select("__id", "__row", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64("__key", F.lit(7919)).alias("__h2"))
    )


def frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Digest, document count and keeper (the largest id) of every key that reaches ``min_docs`` documents."""
    return _frequent(_prepared(df, id_col, text_col), min_chars, min_docs)


def _prepared(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.struct(*carry).alias("carried")] if carry else []
    return df.select(F.col(id_col).alias("__id"), text.alias("__text"), *rest).withColumn("__row", F.xxhash64("__text"))


def _frequent(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    # The first grouping is spread over (key, document), so a line that a third
    # of all documents hold is dealt evenly; the second has a partial aggregate.
    per_doc = _lines(docs, min_chars).select("__h1", "__h2", "__id").distinct()
    return per_doc.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__docs"), F.max("__id").alias("__keep")).filter(F.col("__docs") >= min_docs)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the largest id that holds them.

    Returns one row per input row: ``id_col``, n_lines, n_dropped, kept_text,
    and a struct ``carried`` of the columns named in ``carry``, if any.

    Defined cases: a null or empty text is one empty line. Rows that share an
    id count as one document, and each is rewritten. A null id counts as one
    document that ranks below all others. Lines shorter than ``min_chars`` code
    points after normalisation never go. Other columns are ignored, so none
    clashes. An empty table gives an empty table.
    """
    docs = _prepared(df, id_col, text_col, carry)
    # Written out, so that the join below sees the size: broadcast below the
    # session's threshold, else a sort-merge join whose skewed keys AQE splits.
    frequent = materialise(_frequent(docs, min_chars, min_docs), "frequent-lines")
    dropped = (
        _lines(docs, min_chars)
        .join(frequent, ["__h1", "__h2"])
        .filter(~F.col("__id").eqNullSafe(F.col("__keep")))
        .groupBy(F.col("__id").alias("__did"), F.col("__row").alias("__drow"))
        .agg(F.sort_array(F.collect_set("__pos")).alias("__gone"))
    )
    joined = docs.join(dropped, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__row") == F.col("__drow")), "left")
    rest = ["carried"] if carry else []
    lines = joined.select("__id", "__text", "__gone", *rest, F.split("__text", "\n", -1).alias("__lines"))
    # A mask with a true for each dropped position: linear in the number of lines, where a slice per run is not.
    at = lambda i: F.when(i < 0, F.lit(-1)).otherwise(F.coalesce(F.get("__gone", i), F.size("__lines")))
    mask = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda i: F.concat(F.array_repeat(F.lit(False), at(i) - at(i - 1) - 1), F.array(F.lit(True)))))
    bounded = lines.withColumn("__mask", F.when(F.col("__gone").isNotNull(), mask))
    left = F.zip_with("__lines", "__mask", lambda line, gone: F.when(~gone, line))
    kept = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n"))
    return bounded.select(
        F.col("__id").alias(id_col),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
        *rest,
    )
