"""Mixing sources to target weights.

The words of each source, documents in order of doc_id, are packed into blocks of
``block_words``. Output shards draw how many of their slots each source fills
(multinomial over what each source still has to give, so the drawn totals are the
targets). The k-th slot of a source takes, in its (k / blocks)-th round, the block
at place (k mod blocks) of that round's pseudorandom permutation. Documents are cut at
the borders of groups of blocks, grouped by source and group, and joined with the slots:
``output`` holds every slot of every shard with its block's text, and what is taken of
a document is counted there.

Targets: all words are shared by weight; no target exceeds ``max_repeats`` times
its source, and what a source can't give is shared again among the others.

Defined cases: null and empty texts have size 0 and are never taken; a null
source is a source like any other, last in order; documents of equal doc_id are
ordered by size and text hash, exact repeats stand beside each other; an empty
table gives an empty result; the same rows give the same mix whatever their
partitions. Extra columns are ignored unless kept; the text can't be kept, ``output``
has it. Within a block, parts keep the white space between their words; a line end
stands between parts of two documents.

Scale: one pass over the texts for their sizes, which also packs them; they meet their
offsets by row and are shuffled once more, zipped, in groups of ``GROUP_BLOCKS`` blocks,
so a source that holds most words is dealt out by its blocks. Offsets are on (doc_id, source, size). Running word offsets come from sorted ranges: sums within a range, and the
list of ranges (one row per task and source), so a source that holds most rows is
split like any other. The driver holds one number per source and shard: the mix's
own configuration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, schema_of
from .words import slices, text_bytes, word_bounds
from .zipped import unzipped

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARDS = 64
MAX_REPEATS = 3
SLOTS_PER_TASK = 1 << 20
GROUP_BLOCKS, GROUPS_AT_ONCE = 64, 64
ROUNDS = 4  # of the permutation's mixing network


def word_counts(docs: DataFrame, text: str = "text", name: str = "size", packed: bool = False
                ) -> DataFrame:
    """All columns but the text, its number of words and its hash; ``packed``: also the
    text as ``__zip``."""
    keep = [c for c in docs.columns if c not in (text, name, "text_hash")]  # replaced
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"),
                      F.xxhash64(text).alias("text_hash"))
    plain = src.drop("__text").columns
    schema = schema_of(src.drop("__text"), f"{name} long" + ", __zip binary" * packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zipper = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for b in slices(whole, "__text"):
                first = word_bounds(*text_bytes(b.column("__text")))[2]
                cols = [*[b.column(c) for c in plain], pa.array(np.diff(first), pa.int64())]
                if packed:
                    cols.append(pa.array([zipper.compress(t.encode()) for t in
                                          b.column("__text").to_pylist()], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(count, schema)


def targets(sizes: dict, weights: dict, total: float | None = None,
            max_repeats: int = MAX_REPEATS) -> dict:
    """Words to take of each source: shares of ``total`` by weight, none above
    max_repeats times the source, the excess shared again by weight."""
    left = float(sum(sizes.values()) if total is None else total)
    open_, out = set(sizes), {}
    while open_:
        per_weight = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * per_weight > max_repeats * sizes[s]}
        if not full:
            return out | {s: weights[s] * per_weight for s in open_}
        out |= {s: float(max_repeats * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def cycled_weights(sources: list, weights: tuple[float, ...] = WEIGHTS) -> dict:
    """Weights in turn over the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode())
    order += [None] * (None in sources)
    return {s: weights[k % len(weights)] for k, s in enumerate(order)}


def draw_shards(slots: dict[int, int], shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: each shard draws its slots from a multinomial over
    what the sources still have to give; draws beyond that are drawn again, so the
    columns sum to the slots exactly."""
    ids = sorted(slots)
    left = np.array([slots[i] for i in ids], np.int64)
    counts = np.zeros((shards, len(ids)), np.int64)
    for shard in range(shards):
        rng = np.random.default_rng([seed, shard])
        need = int(left.sum()) // (shards - shard)
        while need > 0:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            counts[shard] += got
            left -= got
            need -= int(got.sum())
    return counts


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, at the given places: a
    Feistel network on the next even number of bits, walked until it falls below n."""
    place, n, key = (np.asarray(x, np.uint64) for x in (place, n, key))
    half = np.ones(len(n), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * half)) < n).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = place.copy(), np.arange(len(place))
    while len(todo):
        a, b, h, m = out[todo] >> half[todo], out[todo] & mask[todo], half[todo], mask[todo]
        for r in range(ROUNDS):
            a, b = b, a ^ (_mix(b, key[todo] + np.uint64(r)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def offsets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``sizes`` with the number of words of the same source before each row."""
    order = ["source_id", "doc_id", "size", "text_hash"]
    placed = scratch.write(sizes.repartitionByRange(*order)
                           .withColumn("part", F.spark_partition_id()), "placed")
    sums = placed.groupBy("source_id", "part").agg(F.sum("size").alias("words"))
    # One row per range and source that meet: as many as ranges and sources together.
    before = sums.select("source_id", "part", F.coalesce(F.sum("words").over(
        Window.partitionBy("source_id").orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = (Window.partitionBy("source_id", "part").orderBy(*order[1:])
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("begun", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(before, ["source_id", "part"])
            .withColumn("begun", F.col("begun") + F.col("before")).drop("before", "part"))


def plan_slots(spark, info: list[dict], counts: np.ndarray, seed: int) -> DataFrame:
    """One row per output slot: shard, slot, source_id, block. Slots are made where
    they are used: the driver gives only counts per shard and source."""
    begun = np.cumsum(counts, axis=0) - counts
    in_shard = np.cumsum(counts, axis=1) - counts
    rows = [(int(m), int(s["source_id"]), int(in_shard[m, j]), int(begun[m, j]),
             int(counts[m, j]), int(s["blocks"]))
            for m in range(len(counts)) for j, s in enumerate(info) if counts[m, j]]
    spans = spark.createDataFrame(rows, "shard int, source_id int, slot long, nth long, "
                                        "n long, blocks long")
    step = 1 << 16
    spans = (spans.select("shard", "source_id", "blocks", "slot", "nth", "n",
                          F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step)))
                          .alias("chunk"))
             .select("shard", "source_id", "blocks", (F.col("slot") + F.col("chunk") * step)
                     .alias("slot"), (F.col("nth") + F.col("chunk") * step).alias("nth"),
                     F.least(F.col("n") - F.col("chunk") * step, F.lit(step)).alias("n"))
             .repartition(max(spark.sparkContext.defaultParallelism,
                              -(-int(counts.sum()) // SLOTS_PER_TASK)),
                          "shard", "source_id", "nth"))
    schema = "shard int, slot long, source_id int, block long"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                nth = np.arange(r["nth"], r["nth"] + r["n"])
                blocks = np.full(r["n"], r["blocks"])
                key = _mix((nth // r["blocks"]).astype(np.uint64),
                           np.uint64(seed * 1_000_003 + r["source_id"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(r["n"], r["shard"]), pa.int32()),
                     pa.array(r["slot"] + np.arange(r["n"]), pa.int64()),
                     pa.array(np.full(r["n"], r["source_id"]), pa.int32()),
                     pa.array(permuted(nth % r["blocks"], blocks, key), pa.int64())],
                    names=["shard", "slot", "source_id", "block"])

    return spans.mapInArrow(expand, schema)


def chunks(rows: DataFrame, words: int) -> DataFrame:
    """The texts of ``rows`` (source_id, doc_id, begun, __zip) cut where groups of ``words``
    words end: source_id, doc_id, group, at (place in the source), from (word of the
    document), begun, __zip."""
    schema = schema_of(rows.select("source_id", "doc_id", "begun"),
                       "group long, at long, from long, __zip binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zipper = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in slices(unzipped(whole), "__text"):
                data, at = text_bytes(b.column("__text"))
                starts, ends, first = word_bounds(data, at)
                if not len(starts):
                    continue
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                nth = np.arange(len(starts)) - first[row]
                place = b.column("begun").to_numpy()[row] + nth
                begin = np.flatnonzero((nth == 0) | (place % words == 0))
                last = np.r_[begin[1:], len(starts)] - 1
                raw = data.tobytes()
                packed = [zipper.compress(raw[s:e]) for s, e in zip(starts[begin], ends[last])]
                own = pa.array(row[begin])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(own) for c in schema.names[:3]],
                     pa.array(place[begin] // words), pa.array(place[begin]),
                     pa.array(nth[begin]), pa.array(packed, pa.binary())], names=schema.names)

    return rows.mapInArrow(cut, schema)


def fill_slots(groups: DataFrame, block_words: int, doc_id: str) -> DataFrame:
    """One row per slot of ``groups`` (source_id; chunks, ordered by place; slots), with its
    block's text and parts."""
    schema = schema_of(groups.select("source_id"), "shard int, slot long, block long, text string, "
                       f"parts array<struct<doc_id:{doc_id},begun:long,from:long,words:long>>")

    def flat(column):
        fields = column.flatten()
        owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        return owner, {f.name: fields.field(k) for k, f in enumerate(fields.type)}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for whole in batches:
            for k in range(0, whole.num_rows, GROUPS_AT_ONCE):
                b = whole.slice(k, GROUPS_AT_ONCE)
                owner, c = flat(b.column("chunks"))
                raws = [unzip.decompress(z) for z in c["__zip"].to_pylist()]
                raw = b"".join(raws)
                at = np.r_[0, np.cumsum([len(x) for x in raws])].astype(np.int64)
                starts, ends, first = word_bounds(np.frombuffer(raw, np.uint8), at)
                row = np.repeat(np.arange(len(raws)), np.diff(first))
                nth = np.arange(len(starts)) - first[row]
                block = (c["at"].to_numpy()[row] + nth) // block_words
                begin = np.flatnonzero((nth == 0) | np.r_[True, block[1:] != block[:-1]])
                end = np.r_[begin[1:], len(starts)]
                texts = [raw[s:e] for s, e in zip(starts[begin], ends[end - 1])]
                own = row[begin]
                # Parts of one block stand beside each other: groups end where blocks do.
                new = np.r_[True, (block[begin][1:] != block[begin][:-1])
                            | (owner[own][1:] != owner[own][:-1])]
                head = np.r_[np.flatnonzero(new), len(begin)]
                text = pa.array([b"\n".join(texts[s:e]) for s, e in zip(head[:-1], head[1:])],
                                pa.binary()).cast(pa.string())
                parts = pa.ListArray.from_arrays(pa.array(head, pa.int32()), pa.StructArray.from_arrays(
                    [c["doc_id"].take(pa.array(own)), c["begun"].take(pa.array(own)),
                     pa.array(c["from"].to_numpy()[own] + nth[begin]), pa.array(end - begin)],
                    names=["doc_id", "begun", "from", "words"]))
                group, s = flat(b.column("slots"))
                # Blocks are in order within a group, so the n-th of a group is found by number.
                of = owner[own][head[:-1]]
                lowest = np.searchsorted(of, np.arange(b.num_rows))
                want = s["block"].to_numpy()
                spot = pa.array(lowest[group] + want - block[begin][head[:-1]][lowest[group]])
                yield pa.RecordBatch.from_arrays(
                    [b.column("source_id").take(pa.array(group)), s["shard"], s["slot"],
                     s["block"], text.take(spot), parts.take(spot)], names=schema.names)

    return groups.mapInArrow(fill, schema)


class Mix:
    """A mix. ``output``: shard, slot, source_id, block, source, the block's text and its
    parts of documents (begun, doc_id, from, words); ``slots``: shard, slot, source_id,
    block; ``blocks``: the parts of documents (first word, words) that a block holds;
    ``documents``: each row with size, source_size, target and taken."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS,
                 block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 17,
                 max_repeats: int = MAX_REPEATS, keep: tuple[str, ...] = ()):
        spark = docs.sparkSession
        if "text" in keep:
            raise ValueError("the mix's words are in output, not in documents")
        own = {"doc_id", "source", "size", "text_hash", "source_size", "target", "taken"}
        keep = tuple(c for c in keep if c not in own)
        scratch = Scratch(spark, "mix")
        rows = docs.select("doc_id", "source", "text", *keep,
                           F.monotonically_increasing_id().alias("__row"))
        texts = scratch.write(word_counts(rows, packed=True), "texts")
        counted = texts.drop("__zip")
        per_source = counted.groupBy("source").agg(F.sum("size").alias("words"))
        sizes = {r["source"]: r["words"] for r in per_source.collect()}
        share = cycled_weights(list(sizes), weights)
        wanted = targets(sizes, share, max_repeats=max_repeats)
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        info = [{"source_id": k, "source": s, "source_size": sizes[s], "target": wanted[s],
                 "blocks": -(-sizes[s] // block_words)} for k, s in enumerate(order)]
        slots = {k: min(round(i["target"] * i["blocks"] / i["source_size"]),
                        max_repeats * i["blocks"]) if i["source_size"] else 0
                 for k, i in enumerate(info)}
        table = spark.createDataFrame(
            [tuple(i.values()) for i in info],
            "source_id int, source string, source_size long, target double, blocks long")
        by_source = counted.join(table, counted["source"].eqNullSafe(table["source"]))
        placed = offsets(by_source.drop(table["source"]), scratch)
        self.slots = plan_slots(spark, info, draw_shards(slots, shards, seed), seed)
        last = F.floor((F.col("begun") + F.col("size") - 1) / block_words)
        first = F.floor(F.col("begun") / block_words)
        full = placed.where("size > 0")
        self.blocks = (full.select("source_id", "doc_id", "text_hash", "begun", "size",
                                   F.explode(F.sequence(first, last)).alias("block"))
                       .withColumn("from", F.greatest(F.col("block") * block_words
                                                      - F.col("begun"), F.lit(0)))
                       .withColumn("words", F.least((F.col("block") + 1) * block_words
                                                    - F.col("begun"), F.col("size"))
                                   - F.col("from")))
        # Texts travel zipped, many blocks at once, and are cut into blocks where slots are.
        group_words = GROUP_BLOCKS * block_words
        pieces = chunks(full.select("__row", "source_id", "doc_id", "begun")
                        .join(texts.select("__row", "__zip").hint("merge"), "__row")
                        .select("source_id", "doc_id", "begun", "__zip"), group_words)
        packed = pieces.groupBy("source_id", "group").agg(F.array_sort(F.collect_list(
            F.struct("at", "begun", "doc_id", "from", "__zip"))).alias("chunks"))
        wanted_slots = (self.slots.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
                        .groupBy("source_id", "group")
                        .agg(F.array_sort(F.collect_list(F.struct("block", "shard", "slot")))
                             .alias("slots")))
        # Slots come from a short list by a Python function, so Spark's estimate of their
        # size is far too low: without the hint it would broadcast them.
        groups = packed.join(wanted_slots.hint("merge"), ["source_id", "group"])
        filled = fill_slots(groups.select("source_id", "chunks", "slots"), block_words,
                            docs.schema["doc_id"].dataType.simpleString())
        self.output = scratch.write(
            filled.join(table.select("source_id", "source"), "source_id"),
            "output", compression="zstd")
        scratch.drop("texts")
        taken = (self.output.select("source_id", F.explode("parts").alias("p"))
                 .groupBy("source_id", "p.begun").agg(F.sum("p.words").alias("taken")))
        # Words stand at one place of one source, so a row with words is known by it.
        self.documents = (placed.withColumn("at", F.when(F.col("size") > 0, F.col("begun")))
                          .join(taken.withColumnRenamed("begun", "at").hint("merge"),
                                ["source_id", "at"], "left")
                          .select("doc_id", *keep, "source", "size", "source_size", "target",
                                  F.coalesce("taken", F.lit(0)).alias("taken")))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every document."""
    return Mix(docs, **options).documents
