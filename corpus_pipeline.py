"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), decides over all of its predecessor's
rows and, but for the last, returns the columns of documents. Rows are told
apart by id and text, so null and repeated ids do no harm; extra columns are
carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.line_dedup import line_dedup
from tessera.llm.ngram_join import ngram_join
from tessera.llm.packing import pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"))
    rejected = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__row")).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["__id"]) & (F.xxhash64(text) == rejected["__row"]), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, except in the largest id that holds them; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup(docs, carry=rest)
    n_chars = lambda c: F.length("kept_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("carried")[c]
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    return out.select(*[(own[c] if c in own else n_chars(c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays, that of the least id; of repeated rows, one. Rows without an id all stay."""
    joined = ngram_join(docs, n=5, threshold=0.8)
    gone = materialise(joined.filter("NOT keeper").select(F.col("doc_id").alias("__gid"), F.col("text_md5").alias("__gtext")).distinct(), "near-copies")
    # Documents are told apart by id and text: an id that is used twice loses only the text that goes.
    rows = docs.withColumn("__text_md5", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    kept = rows.join(gone, (F.col("doc_id") == F.col("__gid")) & (F.col("__text_md5") == F.col("__gtext")), "left_anti")
    key = ["doc_id", "__text_md5"]
    # Counted on narrow rows with partial sums, so that a row repeated very often meets as one row per task.
    repeated = materialise(kept.filter("doc_id IS NOT NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*key), "repeated-rows")
    if not repeated.isEmpty():
        once = kept.join(repeated, key, "left_semi").dropDuplicates(key)
        kept = kept.join(repeated, key, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of packed sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the tokenizer or the edit distances; tests/llm/test_pipeline.py holds every stage to brute force or to SQL of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}") if k < len(STAGES) - 1 else stage(spark, docs, sf_dir)
    return docs
