"""A training corpus from ``documents``: language ID, near-dedup, substring dedup,
benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of ``documents``. Cases that stages define:
empty and null texts go in the language stage, and so do texts that none of the learned
languages explains; the near-dedup stage knows rows by doc_id and text, so different texts
under one doc_id are judged each by itself, rows without doc_id are copies like any other,
and of rows that agree in both one stays; an empty table gives an empty table of the same
columns. Of a run, each stage's table is deleted once the next one is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodlens.llm import decontamination, language_id, minhash_join, mixing, substring_dedup
from periodlens.llm.scratch import Scratch, schema_of
from periodlens.llm.zipped import unzipped, zipped

NEAR_PERCENT = 80  # links of the near-dedup stage; op9's contract alone has 85
MIN_LANGUAGE_SCORE = 0.5  # below, no language is likelier than all others together


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, those that no language explains best, and those that
    their language explains far worse than the words it learned. The models learn from the
    stage's own documents that have a language."""
    own = {c: f"__own_{c}" for c in docs.columns if c in language_id.ADDED}
    rows = docs.withColumnsRenamed(own)
    found = language_id.identify(rows, F.col("lang").isNotNull(), tuple(rows.columns), fits=True)
    return (found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)
                        & (F.col("fit") >= F.col("floor")))
            .select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id (rows without
    one come last)."""
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = minhash_join.near_duplicates(
        rows.select(F.col("__row").alias("doc_id"), "text", F.col("doc_id").alias("__id")),
        ("doc_id", "__id"), percent=NEAR_PERCENT)
    heads = (found.groupBy("component_id")
             .agg(F.min(F.struct(F.col("__id").isNull(), "__id", "doc_id")).alias("head"))
             .select(F.col("head.doc_id").alias("__row")))
    packed = zipped(rows).join(heads, "__row", "left_semi")
    # Rows of one doc_id and text differ in other columns at most.
    others = [c for c in packed.columns if c != "__row"]
    packed = (packed.groupBy("__row").agg(F.min_by(F.struct(*others), F.xxhash64(*others))
                                          .alias("one")).select("one.*"))
    back = packed.mapInArrow(lambda batches: (unzipped(b, "text") for b in batches),
                             schema_of(packed.drop("__zip"), "text string"))
    return back.select(*docs.columns)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated stretches of 20 words and more leave the later texts."""
    found = substring_dedup.substring_dedup(docs)
    return (found.withColumn("n_chars", F.length("text").cast("long"))
            .select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return (decontamination.with_leaks(docs, items).where(F.size("leaks") == 0)
            .select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, counted in the mix itself."""
    return mixed(docs).documents


def mixed(docs: DataFrame) -> mixing.Mix:
    return mixing.Mix(docs, keep=("lang", "n_chars"))


STAGES = [("language_id", identify_language), ("near_dedup", near_dedup),
          ("substring_dedup", dedup_substrings), ("decontamination", decontaminate),
          ("mixing", mix)]

# Model scores, signatures and drawn blocks have no SQL form; the tests compare the
# stages with brute force.
ORACLE_SQL = None


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages before the mix keep; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents`` is made; returns what it takes of each."""
    return STAGES[-1][1](spark, cleaned(spark, sf_dir), sf_dir)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of ``documents``: every shard's slots with their words."""
    return mixed(cleaned(spark, sf_dir)).output
