"""Token counts: the exact histogram of encoded lengths.

Every whole text is encoded with a given public vocabulary; documents are
aggregated by length, and suffix sums over the histogram answer, for every
context limit L that is a length: documents and tokens in all, how many documents
reach L or exceed it, the tokens that are kept when texts are cut at L, and the
share of documents of at most L tokens (every quantile).

Defined cases: null and empty texts have length 0; repeated rows count as often
as they stand; an empty table gives an empty result; extra columns are ignored.
Very long texts are encoded in pieces that end before a white-space run, where
the vocabulary's pattern always starts a new token, so the count is exact.

Scale: counts are aggregated before the shuffle, which has one row per task and
length. Suffix sums are taken within blocks of ``BLOCK`` lengths and between
blocks, so no task sees more than a block or the list of blocks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, schema_of, send

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern of that public vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
PIECE = 1 << 16


def load_encoding(lines: bytes, pattern: str = PATTERN):
    """The encoding of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts a long text where a non-space is followed by one space and a non-space."""
    cut = re.compile(r"(?<=\S)(?= \S)")
    at = 0
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and n_tokens of every row. The vocabulary is read by the driver;
    tasks get its content."""
    sent = send(docs.sparkSession, Path(vocabulary).read_bytes())
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = schema_of(docs.select(*keep), "n_tokens long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(sent())
        for b in batches:
            n = [sum(len(encoding.encode_ordinary(p)) for p in pieces(t)) if t else 0
                 for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())],
                                             names=[*keep, "n_tokens"])

    return src.mapInArrow(encode, schema)


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text"
                     ) -> DataFrame:
    return (encoded_lengths(docs, vocabulary, text).groupBy(F.col("n_tokens").alias("length"))
            .agg(F.count(F.lit(1)).alias("docs")))


def limits(histogram: DataFrame) -> DataFrame:
    """One row per length, taken as context limit. The histogram is read twice, so it is
    written first: the texts are encoded once."""
    histogram = Scratch(histogram.sparkSession, "lengths").write(histogram, "histogram")
    h = (histogram.withColumn("tokens", F.col("docs") * F.col("length"))
         .withColumn("block", F.floor(F.col("length") / BLOCK)))
    from_here = (Window.partitionBy("block").orderBy(F.col("length").desc())
                 .rowsBetween(Window.unboundedPreceding, 0))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    above = (Window.orderBy(F.col("block").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(everything).alias("total_docs"),
        F.sum("tokens").over(everything).alias("total_tokens"))
    return (h.withColumn("docs_reaching", F.sum("docs").over(from_here))
            .withColumn("tokens_reaching", F.sum("tokens").over(from_here))
            .join(blocks, "block")
            .withColumn("docs_reaching", F.col("docs_reaching") + F.col("docs_above"))
            .withColumn("tokens_reaching", F.col("tokens_reaching") + F.col("tokens_above"))
            .select("length", "docs", "tokens", "docs_reaching",
                    (F.col("docs_reaching") - F.col("docs")).alias("docs_over"),
                    "tokens_reaching",
                    (F.col("total_tokens") - F.col("tokens_reaching")
                     + F.col("docs_reaching") * F.col("length")).alias("tokens_truncated"),
                    "total_docs", "total_tokens",
                    ((F.col("total_docs") - F.col("docs_reaching") + F.col("docs"))
                     / F.col("total_docs")).alias("quantile")))


def at_limit(table: DataFrame, limit: int) -> dict:
    """Totals for any context limit, from the first length that reaches it."""
    r = table.where(F.col("length") >= limit).orderBy("length").first()
    if r is None:
        last = table.orderBy(F.col("length").desc()).first()
        n = last["total_tokens"] if last else 0
        return {"docs_over": 0, "tokens_truncated": n, "total_tokens": n}
    return {"docs_over": r["docs_over"] if r["length"] == limit else r["docs_reaching"],
            "tokens_truncated": r["total_tokens"] - r["tokens_reaching"]
            + r["docs_reaching"] * limit, "total_tokens": r["total_tokens"]}


def quantile(table: DataFrame, share: float) -> int | None:
    """The least length that at least this share of documents does not exceed."""
    r = table.where(F.col("quantile") >= share).orderBy("length").first()
    return None if r is None else r["length"]
