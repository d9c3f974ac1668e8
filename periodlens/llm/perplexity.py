"""Quality rules: word n-gram perplexity with language-specific bands.

Per language, a modified Kneser-Ney model of order 2 over words: A-Z lower-cased, split at
punctuation, line ends and blanks; a piece between punctuation starts afresh. Spark counts
the n-grams of all texts, and the model grows with them. It stays distributed, as sorted
hash arrays:

1. Slices of texts of one language are written once, as word numbers with a dictionary,
   and stay where they are: later passes bring the model's numbers to them.
2. Equal pieces count once, wherever they stand: a slice's distinct pieces go to hash
   ranges as sorted arrays of hashes; a range merges them and answers each slice, in its
   own order, which pieces it is the first one to hold.
3. The n-grams of those pieces are summed and dealt in the same way. The answer is every
   n-gram's count in all of them, and whether the slice is the first one that holds it.
4. From the n-grams it is first for, a slice sums for each word how many words follow it
   once, twice and more often, how often any does, and how many precede it. These go the
   same way by word, and come back summed over all texts.
5. With its n-grams' counts and its words' sums a slice scores its texts.

A text is scored by what other pieces say: the counts of its own pieces, also where a copy
has them, are taken off every number but the discounts and the numbers of successors. So
copies do not vouch for each other, and a copy scores like a text by itself. The mean negative log probability of its
words must lie within its language's band: from the median, ``width`` median absolute
deviations up and ``low_width`` down, and ``short`` over the root of its words (a short
text's mean varies more). Words that no other text has are the dearest: letters at random
fail in any script. Words that hold a symbol are outside of the vocabulary: they are not
counted, cost as much as a word never seen, and the next word starts afresh. The band is
wider below, since texts edited from one source vouch for each other in part.

Defined cases: null texts and texts without words have no perplexity and fail the base
rules; a null language is a language like any other; repeated rows count as often as they
stand; an empty table gives an empty result; extra columns pass where ``keep`` names them.

Scale: per distinct n-gram of a slice about two bytes go to the ranges and one comes back;
a hot n-gram is one number per slice. Texts are not shuffled: the slices' table is bucketed
by the task that wrote it. A task holds the slices of one input split and their answers, a
range about ``PART_MASS`` occurrences; the number of ranges follows the mass. The shuffle
files of a pass go before the next one begins. Of each
language a dozen numbers are summed, and joined to the slices. N-grams are told apart by
hashes of 12 bits more than their number has."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collocations import Slice, language_seed, pack_keys, pieces_of, unpack_keys
from .scratch import Scratch, freed_shuffles, schema_of, small_batches
from .substring_dedup import pack_small, unpack_small
from .text_stats import text_counts
from .words import _R, lean, mix, row_sums, slices, text_bytes

SLICE = 4 << 20
HELD = 4 * SLICE
PART_MASS = 1 << 23
SPARE_BITS = 12
WIDTH, LOW_WIDTH, SHORT = 6.0, 18.0, 3.0
SYMBOLS = b"#*$%&|<>@^~=+_\\/{}[]"
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PIECES, PAIRS, WORDS, MODEL = range(4)  # kinds of answers
NO_LANGUAGE = "\x00"  # a null language, as a key


# --- slices ------------------------------------------------------------------------------

def _doc_type(docs: DataFrame, keep: tuple[str, ...]) -> T.ArrayType:
    return T.ArrayType(schema_of(docs.select(*keep), ", ".join(
        f"{c} long" for c in ("__own", *BASE_COUNTS))))


def word_slices(docs: DataFrame, keep: tuple[str, ...], lang: str, text: str) -> DataFrame:
    """home (task), slice, lang, words, mass, sizes (words of each text) and docs: the
    ``keep`` columns and base counts of each text."""
    src = docs.select(*keep, F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE))
                      .alias("__lang"), F.col(text).alias("__text"))
    kept = [f"__k{i}" for i in range(len(keep))]
    schema = T._parse_datatype_string(
        "home int, slice long, lang string, words binary, mass long, sizes binary")
    schema = schema.add("docs", _doc_type(docs, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def done(language: str) -> pa.RecordBatch:
            nonlocal number
            parts = held.pop(language)
            size.pop(language)
            number += 1
            s = Slice.of(language, [p[:2] for p in parts])
            rows = pa.concat_arrays([p[3] for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([(task << 32) + number]),
                 pa.array([language]), pa.array([s.packed()], pa.binary()),
                 pa.array([len(s.ids)]),
                 pa.array([pack_small(np.concatenate([p[2] for p in parts]))], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)],
                names=schema.names)

        for whole in batches:
            for b in slices(whole, "__text"):
                codes = b.column("__lang").dictionary_encode()
                for k, language in enumerate(codes.dictionary.to_pylist()):
                    mine = b.filter(pa.array(codes.indices.to_numpy() == k))
                    words, new, own = pieces_of(mine.column("__text"), rows=True)
                    found = text_counts(*text_bytes(mine.column("__text")), BASE_COUNTS)
                    fields = [*mine.columns[:len(kept)], pa.array(own, pa.int64()),
                              *[pa.array(found[c], pa.int64()) for c in BASE_COUNTS]]
                    rows = pa.StructArray.from_arrays(
                        fields, names=[*mine.schema.names[:len(kept)], "__own", *BASE_COUNTS])
                    held.setdefault(language, []).append((words, new, own, rows))
                    size[language] = (size.get(language, 0) + words.nbytes + len(words)
                                      + 64 * mine.num_rows)
                    if size[language] > SLICE:
                        yield done(language)
                while sum(size.values()) > HELD:
                    yield done(max(size, key=size.get))
        for language in list(held):
            yield done(language)

    return src.mapInArrow(run, schema)


class Pieces:
    """The pieces of a slice: ``keys`` are the sorted hashes of the distinct ones, ``at``
    says which one each piece has, ``of`` the piece of each word."""

    def __init__(self, s: Slice, bits: int):
        self.of = np.cumsum(s.new) - 1
        begin = np.flatnonzero(s.new)
        place = (np.arange(len(s.ids)) - begin[self.of]).astype(np.uint64)
        words = mix(s.hashes() + mix(place + np.uint64(1)))
        sums = np.add.reduceat(words, begin) if len(begin) else words
        self.keys, self.first_here, self.at = np.unique(
            mix(sums) >> np.uint64(64 - bits), return_index=True, return_inverse=True)

    def counted(self, first: np.ndarray) -> np.ndarray:
        """Words of the pieces that this slice counts for all."""
        count = np.zeros(len(self.at), bool)
        count[self.first_here[first]] = True
        return count[self.of]

    def once(self, doc: np.ndarray) -> np.ndarray:
        """Words of the first one of equal pieces of a text; ``doc``: of each word."""
        begin = np.flatnonzero(np.diff(self.of, prepend=-1))
        _, first = np.unique(doc[begin] * len(self.keys) + self.at, return_index=True)
        out = np.zeros(len(self.at), bool)
        out[first] = True
        return out[self.of]


class Grams:
    """Words and word pairs of a slice: ``keys`` are their sorted hashes, ``word`` and
    ``pair`` say which key each one has; the last word is the start of a piece."""

    def __init__(self, s: Slice, bits: int):
        n = len(s.dictionary)
        start = mix(np.array([language_seed(s.lang)], np.uint64) ^ np.uint64(_R))
        words = np.concatenate([s.word_hashes(), start])
        self.after = np.asarray(s.ids, np.int64)
        self.odd = with_symbols(s.dictionary)[self.after]
        self.before = np.full(len(s.ids), n)
        self.before[1:] = np.where(self.odd[:-1], n, self.after[:-1])
        self.before[s.new] = n
        code, self.at = np.unique(self.before * (n + 1) + self.after, return_inverse=True)
        self.first, self.second = code // (n + 1), code % (n + 1)
        pairs = mix(words[self.first] * np.uint64(_R) + words[self.second])
        cut, one = np.uint64(65 - bits), np.uint64(1)
        words, pairs = (words >> cut) << one, ((pairs >> cut) << one) | one
        self.n = n + 1
        self.keys, self.pair = np.unique(pairs, return_inverse=True)
        self.word_keys, self.word_at = np.unique(words, return_inverse=True)

    def counts(self, counted: np.ndarray) -> np.ndarray:
        """Of each key, over the words that ``counted`` marks."""
        times = np.bincount(self.at[counted & ~self.odd], minlength=len(self.pair))
        return _add(self.pair, times, len(self.keys))


def with_symbols(dictionary: list[bytes]) -> np.ndarray:
    """Which words are outside of every vocabulary: those that hold a symbol."""
    size = np.array([len(w) for w in dictionary], np.int64)
    data = np.frombuffer(b"".join(dictionary), np.uint8)
    symbol = np.isin(np.arange(256), list(SYMBOLS))[data]
    return row_sums(symbol, np.r_[0, np.cumsum(size)]) > 0


def _add(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


# --- sums by hash range --------------------------------------------------------------------

SUMS = "part int, home int, slice long, lang string, keys binary, sums binary"
ANSWERS = ("home int, slice long, kind int, part int, sums binary, first binary, "
           "lang string, numbers array<long>, model array<double>")
SUM_NAMES, ANSWER_NAMES = ([c.split()[0] for c in x.split(", ")] for x in (SUMS, ANSWERS))


def pack_columns(columns: list[np.ndarray]) -> bytes:
    import zstandard

    blobs = [pack_small(c) for c in columns]
    return (np.array([len(blobs), *map(len, blobs)], "<i8").tobytes()
            + zstandard.ZstdCompressor(level=1).compress(b"".join(blobs)))


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n = int(np.frombuffer(blob, "<i8", 1)[0])
    edges = np.r_[0, np.cumsum(np.frombuffer(blob, "<i8", n, 8))].astype(int)
    body = zstandard.ZstdDecompressor().decompress(blob[8 + 8 * n:])
    return [unpack_small(body[a:b]) for a, b in zip(edges, edges[1:])]


def dealt(home: int, number: int, lang: str, keys: np.ndarray, columns: list[np.ndarray],
          bits: int, parts: int) -> pa.RecordBatch:
    """Sorted keys and their sums, cut by hash range."""
    edges = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << bits) // parts + 1)
    cut = np.r_[0, np.searchsorted(keys, edges), len(keys)]
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, *_ in rows], pa.int32()), pa.array([home] * n, pa.int32()),
         pa.array([number] * n, pa.int64()), pa.array([lang] * n, pa.string()),
         pa.array([pack_keys(keys[a:b]) for _, a, b in rows], pa.binary()),
         pa.array([pack_columns([c[a:b] for c in columns]) for _, a, b in rows], pa.binary())],
        names=SUM_NAMES)


def merged(sums: DataFrame, parts: int, kind: int, numbers) -> DataFrame:
    """Answers to each slice, in the order of its keys: their sums over all slices, and
    whether it is the first that has them. ``numbers`` sums what a language has of the
    distinct keys' sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lean()
        zipper = zstandard.ZstdCompressor(level=1)
        part, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys = [unpack_keys(x[3]) for x in held]
            cut = np.cumsum([len(k) for k in keys])
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            first = np.zeros(len(which), bool)
            first[np.unique(which, return_index=True)[1]] = True
            del keys
            width = int(np.frombuffer(held[0][4], "<i8", 1)[0])
            packed = [unpack_columns(x[4]) for x in held]
            total = [_add(which, np.concatenate([p[c] for p in packed]), len(key))
                     for c in range(width)]
            del packed
            by_lang: dict[str, np.ndarray] = {}
            for (home, number, lang, *_), b, a in zip(held, cut, np.r_[0, cut[:-1]]):
                mine, new = which[a:b], first[a:b]
                own = numbers([t[mine[new]] for t in total])
                by_lang[lang] = by_lang.get(lang, 0) + own
                yield _answer([home], [number], [kind], [part],
                              [pack_columns([t[mine] for t in total])],
                              [zipper.compress(np.packbits(new).tobytes())],
                              [None], [None], [None])
            n = len(by_lang)
            none = [None] * n
            yield _answer(none, none, [kind] * n, none, none, none, list(by_lang),
                          [x.tolist() for x in by_lang.values()], none)

        for b in batches:
            for p, *rest in zip(*(b.column(c).to_pylist() for c in SUM_NAMES)):
                if p != part:
                    yield from done()
                    part, held = p, []
                held.append(rest)
        yield from done()

    return (sums.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "slice")
            .mapInArrow(run, ANSWERS))


def _answer(*columns) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(),
             pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=ANSWER_NAMES)


def piece_sums(table: DataFrame, bits: int, parts: int) -> DataFrame:
    """Each slice's distinct pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for home, number, lang, blob in zip(*(b.column(c).to_pylist() for c in (
                    "home", "slice", "lang", "words"))):
                keys = Pieces(Slice.unpacked(lang, blob), bits).keys
                yield dealt(home, number, lang, keys, [np.zeros(len(keys), np.int64)], bits, parts)

    return table.select("home", "slice", "lang", "words").mapInArrow(run, SUMS)


def gram_sums(table: DataFrame, answers: DataFrame, bits: int, parts: int) -> DataFrame:
    """Each slice's distinct pairs, counted in the pieces that it is the first to hold."""
    def sums(home: int, s: Slice, number: int, known: dict) -> pa.RecordBatch:
        _, first = joined_answer(known[PIECES])
        grams = Grams(s, bits)
        return dealt(home, number, s.lang, grams.keys,
                     [grams.counts(Pieces(s, bits).counted(first))], bits, parts)

    return _at_home(table, answers, sums)


def _at_home(table: DataFrame, answers: DataFrame, sums) -> DataFrame:
    """Sums of each slice that has answers, made where it stands."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        known = answers_of(right)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.Table.from_batches(
            [sums(home, Slice.unpacked(lang, blob), number, known[number])
             for home, number, lang, blob in zip(*(left.column(c).to_pylist() for c in (
                 "home", "slice", "lang", "words"))) if number in known],
            schema=pa.schema(list(zip(SUM_NAMES, kinds))))

    return (table.select("home", "slice", "lang", "words").groupBy("home")
            .cogroup(answers.groupBy("home")).applyInArrow(run, SUMS))


def _times(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, how many there are, and their sum."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(counts), int(counts.sum())]


def pair_numbers(columns: list[np.ndarray]) -> np.ndarray:
    return np.array(_times(columns[0]))


def word_numbers(columns: list[np.ndarray]) -> np.ndarray:
    return np.array(_times(columns[4][columns[4] > 0]))


def answers_of(table: pa.Table) -> dict:
    """slice -> kind -> (columns over all its keys, which it is first for, model)."""
    out: dict = {}
    rows = sorted(zip(*(table.column(c).to_pylist() for c in (
        "slice", "kind", "part", "sums", "first", "model"))),
        key=lambda r: (r[0], r[1], r[2] or 0))
    for number, kind, _, sums, first, model in rows:
        out.setdefault(number, {}).setdefault(kind, []).append((sums, first, model))
    return out


def joined_answer(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    unzip, columns, firsts = zstandard.ZstdDecompressor(), [], []
    for sums, first, _ in rows:
        columns.append(unpack_columns(sums))
        firsts.append(np.unpackbits(np.frombuffer(unzip.decompress(first), np.uint8),
                                    count=len(columns[-1][0])).astype(bool))
    return [np.concatenate(c) for c in zip(*columns)], np.concatenate(firsts)


def context_sums(table: DataFrame, answers: DataFrame, bits: int, parts: int) -> DataFrame:
    """Of each slice's words, from the pairs it is first for: how many pairs they start
    that occur once, twice and more often, how often in all, and how many they end."""
    def sums(home: int, s: Slice, number: int, known: dict) -> pa.RecordBatch:
        grams = Grams(s, bits)
        (count,), first = joined_answer(known[PAIRS])
        own = first[grams.pair] & (count[grams.pair] > 0)
        c, v, w = count[grams.pair][own], grams.first[own], grams.second[own]
        per = [np.bincount(v[c == 1], minlength=grams.n),
               np.bincount(v[c == 2], minlength=grams.n),
               np.bincount(v[c > 2], minlength=grams.n), _add(v, c, grams.n),
               np.bincount(w, minlength=grams.n)]
        size = len(grams.word_keys)
        return dealt(home, number, s.lang, grams.word_keys,
                     [_add(grams.word_at, x, size) for x in per], bits, parts)

    return _at_home(table, answers, sums)


# --- the model -------------------------------------------------------------------------------

def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers
    of n-grams seen once to four times; the usual fixed ones where those are missing."""
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(1 - 2 * y * n2 / n1, 0.01), 0.99), min(max(2 - 3 * y * n3 / n2, 0.01), 1.99),
            min(max(3 - 4 * y * n4 / n3, 0.01), 2.99)]


def model_numbers(pairs: list[int], words: list[int]) -> list[float]:
    """A language's discounts of pairs and of words, the number of kinds of pairs, the
    share left to unseen words, and the number of words."""
    below, kinds, types = discounts(*words[:4]), words[5], max(words[4], 1)
    left = (below[0] * words[0] + below[1] * words[1]
            + below[2] * (words[4] - words[0] - words[1]))
    return [*discounts(*pairs[:4]), *below, float(max(kinds, 1)), left / max(kinds, 1),
            float(types)]


def _less(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after their discounts."""
    return np.maximum(counts - np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2])), 0)


def text_scores(grams: Grams, pieces: Pieces, sizes: np.ndarray, pair_count: np.ndarray,
                contexts: list[np.ndarray], model: np.ndarray) -> np.ndarray:
    """Summed log probability of each text's words, by what the other texts have.
    ``pair_count``: of each pair; ``contexts``: the five sums of each word."""
    n, pairs = grams.n, max(len(grams.pair), 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    once_here = pieces.once(doc) & ~grams.odd
    both, at = np.unique(doc * pairs + grams.at, return_inverse=True)
    pair, pair_doc = both % pairs, both // pairs
    # Of a pair in the pieces of other texts.
    others = pair_count[pair] - np.bincount(at[once_here], minlength=len(both))
    starts, start = np.unique(doc * n + grams.before, return_inverse=True)
    started = np.bincount(start[once_here], minlength=len(starts))
    once, twice, more, total, ends = contexts
    # Kinds of pairs that only this text has are no evidence for their second word.
    second, which = np.unique(pair_doc * n + grams.second[pair], return_inverse=True)
    alone = np.bincount(which, weights=others == 0, minlength=len(second))
    kinds, unseen = np.maximum(ends[second % n] - alone, 0), model[7] / model[8]
    low = (_less(kinds, model[3:6]) / model[6] + unseen)[which][at]
    v = grams.before
    rest = total[v] - started[start]
    back = (model[0] * once + model[1] * twice + model[2] * more)[v]
    p = np.where(rest > 0, _less(others, model[:3])[at] / np.maximum(rest, 1)
                 + np.minimum(back / np.maximum(rest, 1), 1) * low, low)
    p[grams.odd] = unseen
    return row_sums(np.log(np.minimum(p, 1)), np.r_[0, np.cumsum(sizes)])


def scored(table: DataFrame, answers: DataFrame, keep: T.StructType, bits: int) -> DataFrame:
    """``keep`` columns, base counts, model_words and nll of every text."""
    schema = T.StructType(keep.fields + T._parse_datatype_string(
        ", ".join(f"{c} long" for c in BASE_COUNTS) + ", model_words long, nll double").fields)
    names = [f.name for f in schema]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        known, out = answers_of(right), []
        for i in range(left.num_rows):
            number, lang, blob = (left.column(c)[i].as_py() for c in ("slice", "lang", "words"))
            docs = left.column("docs")[i].values
            sizes = unpack_small(left.column("sizes")[i].as_py())
            total = np.zeros(len(sizes))
            if number in known and PAIRS in known[number]:
                s = Slice.unpacked(lang, blob)
                grams = Grams(s, bits)
                (count,), _ = joined_answer(known[number][PAIRS])
                contexts, _ = joined_answer(known[number][WORDS])
                total = text_scores(grams, Pieces(s, bits), sizes, count[grams.pair],
                                    [c[grams.word_at] for c in contexts],
                                    np.array(known[number][MODEL][0][2]))
            nll = pa.array(-total / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)
            out.append(pa.RecordBatch.from_arrays(
                [*[docs.field(c) for c in [*keep.names, *BASE_COUNTS, "__own"]], nll],
                names=names))
        return pa.Table.from_batches(out)

    return (table.select("home", "slice", "lang", "words", "sizes", "docs").groupBy("home")
            .cogroup(answers.groupBy("home")).applyInArrow(run, schema))


def with_nll(docs: DataFrame, keep: tuple[str, ...], lang: str, text: str,
             part_mass: int = PART_MASS) -> DataFrame:
    """``keep`` columns, base counts, model_words and nll (null without words)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "perplexity")
    table = scratch.write_at_home(word_slices(docs, keep, lang, text), "slices",
                                  docs.rdd.getNumPartitions())
    mass = table.agg(F.sum("mass")).first()[0] or 0
    bits = min(62, max(20, math.ceil(math.log2(mass + 2)) + SPARE_BITS))
    parts = max(1, -(-mass // part_mass))
    with freed_shuffles(spark):
        pieces = scratch.write(merged(piece_sums(table, bits, parts), parts, PIECES, pair_numbers)
                               .where("home is not null"), "pieces")
        counts = scratch.write(merged(gram_sums(table, pieces, bits, parts), parts, PAIRS,
                                      pair_numbers), "counts")
        scratch.drop("pieces")
        asked = counts.where("home is not null")
        contexts = scratch.write(merged(context_sums(table, asked, bits, parts), parts, WORDS,
                                        word_numbers), "contexts")
    summed = [answers.where("home is null").select("lang", F.posexplode("numbers"))
              .groupBy("lang", "pos").agg(F.sum("col").alias("n"))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "n")))
                                   .getField("n").alias(name))
              for answers, name in ((counts, "pairs"), (contexts, "words"))]
    model = F.udf(lambda p, w: model_numbers(p, w), "array<double>")("pairs", "words")
    models = summed[0].join(summed[1], "lang").select("lang", model.alias("model"))
    told = (table.select("home", "slice", "lang").join(models, "lang")
            .select("home", "slice", F.lit(MODEL).alias("kind"), "model"))
    answers = (asked.unionByName(contexts.where("home is not null"))
               .unionByName(told, allowMissingColumns=True))
    with freed_shuffles(spark):
        rows = scratch.write(scored(table, answers, docs.select(*keep).schema, bits), "scored")
    scratch.drop("slices", "counts", "contexts")
    return rows


def judge_perplexity(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), lang: str = "lang",
                     text: str = "text", width: float = WIDTH, low_width: float = LOW_WIDTH,
                     short: float = SHORT, part_mass: int = PART_MASS) -> DataFrame:
    """``keep`` columns, the base counts and ``base_failed``, perplexity with its band
    (``low``, ``high``) and ``kept``. The band is taken from texts that pass the base."""
    cols = (*keep, *(() if lang in keep else (lang,)))
    rows = with_nll(docs, cols, lang, text, part_mass)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50)
                           | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # Rounded to 1e-4, a language has a bounded number of values to find a median in.
    good = rows.where("not base_failed").select(F.col(lang).alias("of"), "nll")
    middle = good.groupBy("of").agg(F.percentile(F.round("nll", 4), F.lit(0.5)).alias("middle"))
    off = (good.join(middle.withColumnRenamed("of", "to"), F.col("of").eqNullSafe(F.col("to")))
           .select("of", "middle", F.round(F.abs(F.col("nll") - F.col("middle")), 4).alias("off")))
    bands = off.groupBy("of", "middle").agg(F.percentile("off", F.lit(0.5)).alias("spread"))
    more = F.lit(short) / F.sqrt(F.greatest(F.col("model_words"), F.lit(1)))
    return (rows.join(bands, rows[lang].eqNullSafe(bands["of"]), "left")
            .withColumn("perplexity", F.exp("nll"))
            .withColumn("low", F.exp(F.col("middle") - low_width * F.col("spread") - more))
            .withColumn("high", F.exp(F.col("middle") + width * F.col("spread") + more))
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(
                F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False)))
            .select(*keep, *BASE_COUNTS, "base_failed", "perplexity", "low", "high", "kept"))
