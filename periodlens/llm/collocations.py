"""Phrase collocations from mergeable Misra-Gries summaries and an exact second pass.

Texts (A-Z lower-cased) are split at punctuation and line ends into pieces, pieces at
blanks into words; a phrase is 1 to ``longest`` words in a row within a piece, counted
per language, overlaps included. Which phrases may be frequent is found first:

1. Slices of one language are written once, as word numbers and their dictionary.
2. A slice sums its phrases by a hash; each partition of the hash space gets the sums of
   all slices and merges them into one Misra-Gries summary. Its capacity exceeds the
   partition's mass (all occurrences) divided by ``min_count``; whenever more counters
   are held, the (capacity + 1)-th largest is taken off all of them, so each unit taken
   off costs capacity + 1 units of mass. All that is taken off stays below ``min_count``,
   and every phrase that frequent keeps a counter.
   Of those, hashes whose counter and all that was taken off reach ``min_count`` survive.
3. The surviving hashes go back to the slices that hold them; there phrases with such a
   hash are counted exactly, by their words, and summed by phrase. Hash collisions can
   only let more phrases into this pass.

A candidate (2 words and more, ``min_count`` times and more) is scored by its weakest
cut: floor(1000 * a * n / (l * r)) in exact decimals.

Defined cases: null texts count as empty, a null language as ``und``; repeated rows
count as often as they stand; scores tie to the shortest first part, ranks to the more
frequent, then to the smaller phrase in UTF-8 order; other columns are ignored; an empty
table gives an empty result.

Scale: two shuffles of about two bytes per distinct phrase of a slice and of the packed
slices; a hot phrase is one number per slice; a partition holds the packed sums of about
``PART_MASS`` occurrences and a summary of at most a hundredth of that (by ``min_count``).
The number of partitions follows the mass. Memory is bounded by a slice or one text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .substring_dedup import pack_small, unpack_small
from .words import lean, mix, range_hashes, slices, text_bytes, window_hashes, word_bounds

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
SLICE = 4 << 20
HELD = 4 * SLICE  # of all languages of a task
PART_MASS = 1 << 24
HASH_ROOM = 8  # hashes per occurrence
RANK_PARTS = 32
SUM_AT = 1 << 20  # phrases that wait to be summed
BREAKS = b".,;:!?\n\x0b\x0c\r"


class MisraGries:
    """Counters of the heaviest keys: with a capacity above mass / m, every key that
    stands m times or more has one, and a count at most ``off`` too small."""

    def __init__(self, capacity: int, room: int = 1 << 22):
        self.capacity, self.room = capacity, room
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.off = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._n += len(keys)
        if self._n > self.room:
            self.settle()

    def merge(self, other: "MisraGries") -> None:
        other.settle()
        self.off += other.off
        self.add(other.keys, other.counts)

    def candidates(self, least: int) -> np.ndarray:
        """Keys that may stand ``least`` times: no count is off by more than ``off``."""
        self.settle()
        return self.keys[self.counts + self.off >= least]

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self._waiting]
        self._waiting, self._n = [], 0
        keys, counts = sum_by_key(np.concatenate([k for k, _ in parts]),
                                  np.concatenate([c for _, c in parts]))
        if len(keys) > self.capacity:
            at = len(keys) - self.capacity - 1
            less = int(np.partition(counts, at)[at])
            self.off += less
            stay = counts > less
            keys, counts = keys[stay], counts[stay] - less
        self.keys, self.counts = keys, counts


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    bits = max(1, int(keys.max()).bit_length())
    if int(counts.max()).bit_length() + bits <= 64:  # one sort of plain numbers
        up = np.uint64(64 - bits)
        both = np.sort((keys << up) | counts.astype(np.uint64))
        keys = both >> up
        counts = (both & np.uint64((1 << (64 - bits)) - 1)).astype(np.int64)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(counts, new)


# --- slices ------------------------------------------------------------------------

def pieces_of(column, rows: bool = False) -> tuple:
    """(words as binaries, whether each one starts a piece) of a text column; with
    ``rows`` also the number of words of each row."""
    data, at = text_bytes(column)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    ends_piece = np.isin(np.arange(256), list(BREAKS))[data]
    data[ends_piece] = 32
    starts, ends, first = word_bounds(data, at)
    piece = np.cumsum(ends_piece, dtype=np.int64)[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = piece[1:] != piece[:-1]
    new[first[:-1][first[:-1] < len(starts)]] = True
    size = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)])
    return (words, new, np.diff(first)) if rows else (words, new)


class Slice:
    """Words of one language: a dictionary, word numbers and where pieces start."""

    def __init__(self, lang: str, dictionary: list[bytes], ids: np.ndarray, new: np.ndarray):
        self.lang, self.dictionary, self.ids, self.new = lang, dictionary, ids, new

    @classmethod
    def of(cls, lang: str, parts: list[tuple[pa.Array, np.ndarray]]) -> "Slice":
        coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
        return cls(lang, coded.dictionary.to_pylist(), coded.indices.to_numpy(),
                   np.concatenate([n for _, n in parts]))

    def packed(self) -> bytes:
        import zstandard

        zipper = zstandard.ZstdCompressor(level=1)
        parts = [b" ".join(self.dictionary), pack_small(self.ids),
                 np.packbits(self.new).tobytes()]
        sizes = np.array([len(self.dictionary), len(self.ids), *map(len, parts)], "<i8")
        return sizes.tobytes() + zipper.compress(b"".join(parts))

    @classmethod
    def unpacked(cls, lang: str, blob: bytes) -> "Slice":
        import zstandard

        n_words, n, *sizes = np.frombuffer(blob, "<i8", 5).tolist()
        body = zstandard.ZstdDecompressor().decompress(blob[40:])
        a, b = sizes[0], sizes[0] + sizes[1]
        return cls(lang, body[:a].split(b" ") if n_words else [], unpack_small(body[a:b]),
                   np.unpackbits(np.frombuffer(body, np.uint8, offset=b), count=n).astype(bool))

    def windows(self, width: int) -> np.ndarray:
        """Where phrases of ``width`` words start."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        piece = np.cumsum(self.new)
        return np.flatnonzero(piece[:n] == piece[width - 1:])

    def word_hashes(self) -> np.ndarray:
        """A hash of each word of the dictionary, by language."""
        joined = np.frombuffer(b"".join(self.dictionary), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(w) for w in self.dictionary])]).astype(np.int64)
        return mix(range_hashes(joined, at[:-1], at[1:]) ^ np.uint64(language_seed(self.lang)))

    def hashes(self) -> np.ndarray:
        return self.word_hashes()[self.ids]


def language_seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def write_slices(docs: DataFrame, scratch: Scratch, longest: int, lang: str, text: str
                 ) -> DataFrame:
    """slice, lang, words, n_words and mass (occurrences of phrases) of all texts."""
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("__lang"),
                      F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def done(language: str) -> pa.RecordBatch:
            nonlocal number
            s = Slice.of(language, held.pop(language))
            size.pop(language)
            number += 1
            mass = sum(len(s.windows(k)) for k in range(1, longest + 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number]), pa.array([language]),
                 pa.array([s.packed()], pa.binary()), pa.array([len(s.ids)]), pa.array([mass])],
                names=["slice", "lang", "words", "n_words", "mass"])

        for whole in batches:
            for b in slices(whole, "__text"):
                codes = b.column("__lang").dictionary_encode()
                for k, language in enumerate(codes.dictionary.to_pylist()):
                    mine = b.column("__text").filter(pa.array(codes.indices.to_numpy() == k))
                    words, new = pieces_of(mine)
                    if not len(words):
                        continue
                    held.setdefault(language, []).append((words, new))
                    size[language] = size.get(language, 0) + words.nbytes + len(words)
                    if size[language] > SLICE:
                        yield done(language)
                while sum(size.values()) > HELD:
                    yield done(max(size, key=size.get))
        for language in list(held):
            yield done(language)

    return scratch.write(src.mapInArrow(
        run, "slice long, lang string, words binary, n_words long, mass long"), "slices")


# --- first pass: which hashes may be frequent ----------------------------------------

def slice_keys(s: Slice, bits: int, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, where phrases start and their hashes of ``bits`` bits."""
    words, out = s.hashes(), []
    for k in range(1, longest + 1):
        begin = s.windows(k)
        found = window_hashes(words, k)[begin] if len(begin) else np.zeros(0, np.uint64)
        out.append((begin, found >> np.uint64(64 - bits)))
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(
        pack_small(np.diff(keys, prepend=np.uint64(0))))


def unpack_keys(blob: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(unpack_small(zstandard.ZstdDecompressor().decompress(blob))).astype(np.uint64)


def surviving(slices_: DataFrame, bits: int, parts: int, min_count: int, longest: int
              ) -> DataFrame:
    """slice, keys: the hashes of each slice that keep a counter in their partition."""
    width = (1 << bits) // parts + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        mass = np.zeros(parts, np.int64)
        edges = np.arange(1, parts, dtype=np.uint64) * np.uint64(width)
        for b in batches:
            for number, lang, blob in zip(*(b.column(c).to_pylist()
                                            for c in ("slice", "lang", "words"))):
                found = slice_keys(Slice.unpacked(lang, blob), bits, longest)
                keys = np.sort(np.concatenate([k for _, k in found]))
                new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                counts = np.diff(np.r_[new, len(keys)])
                keys = keys[new]
                cut = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                rows = [(p, x, y) for p, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                for p, x, y in rows:
                    mass[p] += counts[x:y].sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, *_ in rows], pa.int32()),
                     pa.array([number] * len(rows), pa.int64()),
                     pa.array([pack_keys(keys[x:y]) for _, x, y in rows], pa.binary()),
                     pa.array([pack_keys(np.cumsum(counts[x:y])) for _, x, y in rows],
                              pa.binary()), pa.nulls(len(rows), pa.int64())],
                    names=["part", "slice", "keys", "counts", "mass"])
        some = np.flatnonzero(mass)
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), none, none,
             pa.array(mass[some])], names=["part", "slice", "keys", "counts", "mass"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        part, mass, held, summary = None, 0, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            known = summary.candidates(min_count)
            assert summary.off < min_count
            for number, blob in held:
                keys = unpack_keys(blob)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                keys = keys[known[at] == keys] if len(known) else keys[:0]
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([pack_keys(keys)], pa.binary())],
                        names=["slice", "keys"])

        for b in batches:  # a partition's masses come before its sums
            for p, number, keys, counts, m in zip(*(b.column(c).to_pylist() for c in (
                    "part", "slice", "keys", "counts", "mass"))):
                if p != part:
                    yield from done()
                    part, mass, held, summary = p, 0, [], None
                if m is not None:
                    mass += m
                    continue
                summary = summary or MisraGries(mass // min_count + 1)
                held.append((number, keys))
                summary.add(unpack_keys(keys), np.diff(unpack_keys(counts).astype(np.int64),
                                                       prepend=0))
        yield from done()

    return (slices_.select("slice", "lang", "words")
            .mapInArrow(sums, "part int, slice long, keys binary, counts binary, mass long")
            .repartitionById(parts, F.col("part"))
            .sortWithinPartitions("part", F.col("mass").isNull())
            .mapInArrow(merge, "slice long, keys binary"))


# --- second pass: exact counts --------------------------------------------------------

def slice_counts(s: Slice, known: np.ndarray, bits: int, longest: int
                 ) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Phrases of the slice with a hash in ``known``, told apart by their words; their
    counts and hashes."""
    table = np.zeros(1 << 22, bool)  # most hashes are ruled out by their low bits
    low = np.uint64(len(table) - 1)
    table[known & low] = True
    dictionary = pa.array(s.dictionary, pa.binary())
    phrases, counts, hashes = [], [], []
    for k, (begin, keys) in enumerate(slice_keys(s, bits, longest), 1):
        maybe = np.flatnonzero(table[keys & low])
        at = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
        maybe = maybe[known[at] == keys[maybe]]
        if not len(maybe):
            continue
        begin = begin[maybe]
        code = s.ids[begin]
        for j in range(1, k):
            code = np.unique(code * len(s.dictionary) + s.ids[begin + j], return_inverse=True)[1]
        _, one, n = np.unique(code, return_index=True, return_counts=True)
        words = [dictionary.take(pa.array(s.ids[begin[one] + j])) for j in range(k)]
        phrases.append(pc.binary_join_element_wise(*words, b" ") if k > 1 else words[0])
        counts.append(n)
        hashes.append(keys[maybe[one]])
    if not phrases:
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return pa.concat_arrays(phrases), np.concatenate(counts), np.concatenate(hashes)


COUNTED = "part int, lang string, phrases binary, counts binary"
COUNTED_NAMES = [c.split()[0] for c in COUNTED.split(", ")]


def exact_counts(slices_: DataFrame, found: DataFrame, bits: int, parts: int, min_count: int,
                 longest: int) -> DataFrame:
    """lang, phrase, f of all phrases that stand ``min_count`` times or more. A slice sends
    its phrases packed by hash range, which sums them by their words."""
    both = (slices_.select("slice", "lang", "words")
            .unionByName(found, allowMissingColumns=True)
            .repartition(parts, "slice").sortWithinPartitions("slice", F.col("words").isNotNull()))
    width = np.uint64((1 << bits) // parts + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lean()
        number, held, zipper = None, [], zstandard.ZstdCompressor(level=1)
        for b in batches:  # a slice's hashes come before its words
            for n, lang, words, keys in zip(*(b.column(c).to_pylist()
                                              for c in ("slice", "lang", "words", "keys"))):
                if n != number:
                    number, held = n, []
                if words is None:
                    held.append(unpack_keys(keys))
                    continue
                if not held:
                    continue
                s = Slice.unpacked(lang, words)
                phrases, counts, hashes = slice_counts(s, np.sort(np.concatenate(held)), bits,
                                                       longest)
                part = (hashes // width).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, counts, phrases = part[order], counts[order], phrases.take(pa.array(order))
                cut = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
                rows = [(int(part[a]), lang,  # no word holds a line end
                         zipper.compress(b"\n".join(phrases.slice(a, b - a).to_pylist())),
                         zipper.compress(pack_small(counts[a:b]))) for a, b in zip(cut, cut[1:])
                        if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*rows), (
                        pa.int32(), pa.string(), pa.binary(), pa.binary()))],
                    names=COUNTED_NAMES)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lean()
        of, held, waiting, unzip = None, [], 0, zstandard.ZstdDecompressor()

        def summed() -> pa.Table:
            table = pa.concat_tables(held).group_by("phrase").aggregate([("f", "sum")])
            return table.rename_columns(["phrase", "f"])

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = summed()
                table = table.filter(pc.greater_equal(table.column("f"), min_count))
                for b in table.to_batches(50_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([of[1]] * b.num_rows, pa.string()),
                         b.column("phrase").cast(pa.string()), b.column("f")],
                        names=["lang", "phrase", "f"])

        for b in batches:
            for part, lang, phrases, counts in zip(*(b.column(c).to_pylist()
                                                     for c in COUNTED_NAMES)):
                if (part, lang) != of:
                    yield from done()
                    of, held, waiting = (part, lang), [], 0
                words = unzip.decompress(phrases).split(b"\n")
                held.append(pa.table({"phrase": pa.array(words, pa.binary()),
                                      "f": unpack_small(unzip.decompress(counts))}))
                waiting += len(words)
                if waiting > SUM_AT:
                    held, waiting = [summed()], 0
        yield from done()

    return (both.mapInArrow(count, COUNTED).repartitionById(parts, F.col("part"))
            .sortWithinPartitions("part", "lang")
            .mapInArrow(total, "lang string, phrase string, f long"))


def frequent_phrases(docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT,
                     longest: int = LONGEST, lang: str = "lang", text: str = "text",
                     part_mass: int = PART_MASS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f of all phrases that stand ``min_count`` times or more; lang, n)."""
    small_batches(docs.sparkSession)
    packed = write_slices(docs, scratch, longest, lang, text)
    mass = packed.agg(F.sum("mass")).first()[0] or 0
    bits = min(60, max(16, math.ceil(math.log2(HASH_ROOM * mass + 1))))
    parts = max(1, -(-mass // part_mass))
    found = surviving(packed, bits, parts, min_count, longest)
    counts = exact_counts(packed, found, bits, 2 * parts, min_count, longest)
    totals = scratch.write(packed.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    frequent = scratch.write(counts, "frequent")
    scratch.drop("slices")
    return frequent, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST,
                 top: int | None = TOP, cover_percent: int = 100, lang: str = "lang",
                 text: str = "text", part_mass: int = PART_MASS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each language's best ``top`` phrases
    (None: all), without those that a longer candidate covers: one that holds their words
    in a row and stands ``cover_percent`` % as often or more."""
    scratch = Scratch(docs.sparkSession, "collocations")
    frequent, totals = frequent_phrases(docs, scratch, min_count, longest, lang, text,
                                        part_mass)
    words = F.split("phrase", " ")
    candidates = frequent.where(F.size(words) > 1).withColumnRenamed("f", "a")
    cuts = (candidates.withColumn("w", words)
            .withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
            .select("lang", "phrase", "a", "cut",
                    F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"),
                    F.expr("array_join(slice(w, cut + 1, size(w) - cut), ' ')").alias("rest")))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .join(totals, "lang")
              .withColumn("over", F.lit(1000).cast("decimal(4,0)") * wide("a", 17) * wide("n", 17))
              .withColumn("under", wide("l", 18) * wide("r", 18))
              .withColumn("score", F.expr("over div under")))
    weakest = (scored.groupBy("lang", "phrase", "a", "n")
               .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
               .select("lang", "phrase", "a", "n", "best.*"))
    inner = (candidates.withColumn("w", words).where(F.size("w") > 2)
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
             .withColumn("from", F.explode(F.expr("sequence(1, size(w) - size + 1)")))
             .select("lang", F.expr("array_join(slice(w, from, size), ' ')").alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left_over = (weakest.join(inner, ["lang", "phrase"], "left")
                 .where(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"),
                                   F.lit(True))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # each part of a language keeps its best before they meet
        left_over = (left_over.withColumn("part", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS)))
                     .withColumn("rank", F.row_number().over(
                         Window.partitionBy("lang", "part").orderBy(*order)))
                     .where(F.col("rank") <= top))
    ranked = left_over.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
