"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

Texts and benchmark items are read as words without case and punctuation; a character of a
script that sets no spaces (Chinese, Japanese kana, Thai, Lao, Burmese, Khmer) is a word by
itself. An item's seeds are its n-grams, and its pairs of words that stand side by side or
with one word between. They are counted over the whole corpus, and of each kind those are
used that are rare for the item: not above ``RARE`` times the median of its own, and its
``SEEDS_LEAST`` rarest in any case. (Copies of an item raise all its seeds alike, so a much
copied item keeps them; a common phrase stands out.) A copy with two words of three kept
keeps pairs even where it keeps no n-gram; a pair counts in a text with or without a word
between, so one word put in or left out does not hide it. Where a text holds an n-gram
seed, or two pair seeds that agree on where the item would stand (one, for items of less
than ``FEW`` words), the stretch around that could hold the item is aligned with the item
word by word (match +2, other word -1, left out or put in -1); the best local alignment
over the item's best possible score is the leak's score, and ``threshold`` decides.

Defined cases: null and empty texts and items have no words; an item under ``NGRAM`` words
is too short to align and matches (score 1) where a piece of a text between line ends,
commas, stops and the like is that item and nothing else; repeated rows are judged each by
itself; equal items are reported each; null ids pass as they are; empty tables give no
leaks; an own column named like an added one is replaced. Stretches are as long as the item
and its margins, plus what lies between seeds less than a margin apart; no candidate is
dropped.

Scale: texts are not shuffled. Both passes (counts, alignment) are one scan each, and a
task sends one number per seed it met. Items go to every task in blocks of about
``ITEMS_AT_ONCE``, one pair of passes per block, so the broadcast keeps its bound. A task
takes as many rows at once as have ``PLACES`` seed places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import schema_of, send
from .words import _R, mix, range_hashes, slices, text_bytes, window_hashes, window_starts

NGRAM = 3
RARE, SEEDS_LEAST = 4, 8
GAPS = (1, 2)  # steps from the first word of a pair to the second
FEW = 12
PLACES = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.45
ITEMS_AT_ONCE = 50_000
PAIR_CELLS = 1 << 21
LEAKS = "leaks array<struct<item_id:long,score:double,first_word:int,last_word:int>>"


# First and last code points: scripts without spaces, and punctuation beside ASCII.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF),
            (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
PUNCTUATION = ((0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20),
               (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
PIECE_ENDS = b".,;:!?\n\r\x0b\x0c"


def _spans(points: np.ndarray, ranges) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for low, high in ranges:
        out |= (points >= low) & (points <= high)
    return out


def bare_words(column, pieces: bool = False) -> tuple:
    """(hashes, first): words of row i, without case and punctuation; with ``pieces`` also
    whether each word starts a piece."""
    data, at = text_bytes(pc.utf8_lower(column))
    letter = np.zeros(256, bool)
    letter[48:58] = letter[97:123] = letter[128:] = True
    inside, ends_piece = letter[data], np.isin(np.arange(256), list(PIECE_ENDS))[data]
    lead = np.flatnonzero((data & 0xF0) == 0xE0)  # of three bytes
    lead = lead[lead + 2 < len(data)]
    point = (((data[lead] & 15).astype(np.int32) << 12)
             | ((data[lead + 1] & 63).astype(np.int32) << 6) | (data[lead + 2] & 63))
    mark = lead[_spans(point, PUNCTUATION)]
    inside[(mark[:, None] + np.arange(3)).ravel()] = False
    ends_piece[mark] = True
    single = lead[_spans(point, UNSPACED)]
    wide = np.flatnonzero((data & 0xF8) == 0xF0)  # of four bytes: further ideographs
    wide = wide[wide + 3 < len(data)]
    plane = ((data[wide] & 7) << 2) | ((data[wide + 1] >> 4) & 3)
    wide = wide[(plane == 2) | (plane == 3)]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    begins, ends = inside & ~before, inside & ~after
    for chars, size in ((single, 3), (wide, 4)):
        begins[chars] = ends[chars + size - 1] = True
        ends[chars[chars > 0] - 1] |= inside[chars[chars > 0] - 1]
        follow = chars[chars + size < len(data)] + size
        begins[follow] |= inside[follow]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, at)
    hashes = range_hashes(data, starts, stops)
    if not pieces:
        return hashes, first
    new = np.ones(len(starts), bool)
    piece = np.cumsum(ends_piece)[starts] if len(starts) else starts
    new[1:] = piece[1:] != piece[:-1]
    new[first[:-1][first[:-1] < len(starts)]] = True
    return hashes, first, new


def pair_hashes(words: np.ndarray, gap: int) -> np.ndarray:
    """A hash of each word and the one ``gap`` words on, the same for every gap."""
    return mix(words[:-gap] * np.uint64(_R) + mix(words[gap:] ^ np.uint64(2)))


def item_seeds(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, positions, weight) of an item's n-grams and pairs; short items have none."""
    if len(words) < NGRAM:
        return []
    kinds = [(window_hashes(words, NGRAM), 2), *((pair_hashes(words, g), 1) for g in GAPS)]
    return [(h, np.arange(len(h)), weight) for h, weight in kinds]


class Seeds:
    """Seeds of the items, each with the places (item, position) it stands at."""

    def __init__(self, items: list[np.ndarray], wanted: np.ndarray | None = None):
        self.items = items
        every = [(k, *kind) for k, w in enumerate(items) for kind in item_seeds(w)]
        size = [len(h) for _, h, _, _ in every]
        self.gram = np.concatenate([*(h for _, h, _, _ in every), np.zeros(0, np.uint64)])
        item = np.repeat([k for k, *_ in every], size).astype(int)
        weight = np.repeat([w for *_, w in every], size).astype(int)
        spot = np.concatenate([*(p for _, _, p, _ in every), np.zeros(0, int)]).astype(int)
        gram = self.gram
        if wanted is not None:
            gram, item, spot, weight = gram[wanted], item[wanted], spot[wanted], weight[wanted]
        order = np.argsort(gram, kind="stable")
        gram, self.item, self.spot = gram[order], item[order], spot[order]
        self.weight = weight[order]
        self.keys, self.first = np.unique(gram, return_index=True)
        self.first = np.r_[self.first, len(gram)]
        self.near = np.zeros(1 << 22, bool)
        self.near[self.keys >> np.uint64(42)] = True
        self.short: dict[int, list[int]] = {}
        for k, w in enumerate(items):
            if 0 < len(w) < NGRAM:
                self.short.setdefault(int(window_hashes(w, len(w))[0]), []).append(k)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in ``grams``, index of the key) wherever a seed is a key."""
        at = np.flatnonzero(self.near[grams >> np.uint64(42)])
        key = np.searchsorted(self.keys, grams[at])
        key = np.minimum(key, max(len(self.keys) - 1, 0))
        hit = self.keys[key] == grams[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[hit], key[hit]

    def in_texts(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word where it starts, index of the key) of every seed in the texts."""
        at, key = [np.zeros(0, int)], [np.zeros(0, int)]
        for width, hashes in ((NGRAM, lambda: window_hashes(words, NGRAM)),
                              *((g + 1, lambda g=g: pair_hashes(words, g)) for g in GAPS)):
            begin = window_starts(first, width)
            if len(begin):
                spot, found = self.find(hashes()[begin])
                at.append(begin[spot])
                key.append(found)
        return np.concatenate(at), np.concatenate(key)


def count_grams(docs: DataFrame, items: list[np.ndarray], text: str) -> np.ndarray:
    """How often each seed of the items stands in the texts, in the items' order."""
    all_seeds = Seeds(items)
    sent = send(docs.sparkSession, all_seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        counts = np.zeros(len(known.keys), np.int64)
        for b in (part for whole in batches for part in slices(whole, "__text")):
            found = known.in_texts(*bare_words(b.column("__text")))[1]
            counts += np.bincount(found, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])],
                                         names=["gram", "n"])

    rows = (docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"))
            .mapInArrow(run, "gram long, n long").groupBy("gram")
            .agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(len(all_seeds.keys), np.int64)
    counts[rows["gram"].to_numpy(int)] = rows["n"].to_numpy(int)
    return counts[np.searchsorted(all_seeds.keys, all_seeds.gram)]


def rare_seeds(items: list[np.ndarray], counts: np.ndarray) -> Seeds:
    """Of each item and kind the seeds that are rare for it (the earlier of equals first)."""
    wanted = np.zeros(len(counts), bool)
    at = 0
    for w in items:
        for hashes, _, _ in item_seeds(w):
            n = len(hashes)
            own = counts[at:at + n]
            wanted[at:at + n] = own <= RARE * max(np.median(own), 1)
            wanted[at + np.argsort(own, kind="stable")[:SEEDS_LEAST]] = True
            at += n
    return Seeds(items, wanted)


def align(items: list[np.ndarray], passages: list[np.ndarray]
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score, and the passage's first and last word."""
    n = len(items)
    rows, cols = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((n, rows), np.uint64), np.ones((n, cols), np.uint64)
    for k in range(n):
        a[k, :len(items[k])], b[k, :len(passages[k])] = items[k], passages[k]
    length = np.array([len(x) for x in items])
    past = np.arange(cols) >= np.array([len(x) for x in passages])[:, None]
    step = GAP * np.arange(cols + 1)
    h = np.zeros((n, cols + 1), np.int64)
    begin = np.tile(np.arange(cols + 1), (n, 1))  # where the alignment in a cell begins
    best, first, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    big = np.int64(cols + 2)
    for i in range(rows):
        match = np.where((a[:, i:i + 1] == b) & ~past, MATCH, MISMATCH)
        diagonal = h[:, :-1] + match
        above = h[:, 1:] + GAP
        cell = np.zeros_like(h)
        came = np.tile(np.arange(cols + 1), (n, 1))
        cell[:, 1:] = np.maximum(np.maximum(diagonal, above), 0)
        came[:, 1:] = np.where((cell[:, 1:] == diagonal) & (diagonal > 0), begin[:, :-1],
                               np.where((cell[:, 1:] == above) & (above > 0), begin[:, 1:],
                                        came[:, 1:]))
        # Gaps along the passage: the best earlier cell, less a gap for every word between.
        packed = (cell - step) * big + (big - 1 - came)
        packed = np.maximum.accumulate(packed, axis=1)
        h, begin = packed // big + step, big - 1 - packed % big
        h[:, 1:][past] = 0
        live = i < length
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        better = live & (value > best)
        best[better], last[better] = value[better], top[better] - 1
        first[better] = begin[np.arange(n), top][better]
    return best, first, last


def passages(hits_row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, weight: np.ndarray,
             sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hits of one row and item whose diagonals lie within a margin become one stretch:
    row, item, least and largest diagonal. One pair alone is none, but for short items."""
    order = np.lexsort((diagonal, item, hits_row))
    r, i, d, weight = hits_row[order], item[order], diagonal[order], weight[order]
    if not len(r):
        return r, i, d, d
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (d[1:] - d[:-1] > margin(sizes[i[1:]]))
    start = np.flatnonzero(new)
    last = np.r_[start[1:], len(d)] - 1
    enough = (np.add.reduceat(weight, start) > 1) | (sizes[i[start]] < FEW)
    return r[start][enough], i[start][enough], d[start][enough], d[last][enough]


def margin(size):
    return np.maximum(4, size // 4)


def with_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
               text: str = "text") -> DataFrame:
    """All columns and ``leaks``: the items found, best score first within its block."""
    n_items = items.count()
    blocks = max(1, -(-n_items // ITEMS_AT_ONCE))
    columns = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*columns, F.array().cast(LEAKS.split(" ", 1)[1]).alias("leaks"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.select("item_id", F.coalesce("text", F.lit("")).alias("text")).collect()
        if not rows:
            continue
        words, first = bare_words(pa.array([r["text"] for r in rows], pa.string()))
        words = [words[a:b] for a, b in zip(first[:-1], first[1:])]
        seeds = rare_seeds(words, count_grams(docs, words, text))
        out = _find_leaks(out, seeds, [r["item_id"] for r in rows], threshold, text)
    return out


def _find_leaks(docs: DataFrame, seeds: Seeds, ids: list, threshold: float, text: str
                ) -> DataFrame:
    sent = send(docs.sparkSession, seeds)
    schema = schema_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for b in (part for whole in batches for part in slices(whole, text)):
            found = slice_leaks(b.column(text), known, threshold)
            if found:
                leaks = b.column("leaks").to_pylist()
                for row, item, score, first, last in found:
                    leaks[row] = (leaks[row] or []) + [
                        {"item_id": ids[item], "score": score, "first_word": first,
                         "last_word": last}]
                at = b.schema.get_field_index("leaks")
                field = b.schema.field(at)  # all batches of a task have one schema
                b = b.set_column(at, field, pa.array(leaks, field.type))
            yield b

    return docs.mapInArrow(run, schema)


def short_leaks(words: np.ndarray, first: np.ndarray, new: np.ndarray, seeds: Seeds) -> dict:
    """(row, item) -> (score, first, last word) where a piece is an item under NGRAM words."""
    out: dict = {}
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(words)])
    keys = np.array(sorted(seeds.short), np.uint64)
    for n in range(1, NGRAM):
        at = begin[size == n]
        if not len(at) or not len(keys):
            continue
        found = window_hashes(words, n)[at]
        spot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        for a, key in zip(at[keys[spot] == found].tolist(), found[keys[spot] == found].tolist()):
            row = int(np.searchsorted(first, a, "right") - 1)
            for item in seeds.short[key]:
                if len(seeds.items[item]) == n:
                    out.setdefault((row, item), (1.0, int(a - first[row]),
                                                 int(a - first[row] + n - 1)))
    return out


def slice_leaks(column, seeds: Seeds, threshold: float) -> list[tuple]:
    """(row, item, score, first word, last word) of the texts' leaks, one per row and item."""
    words, first, new = bare_words(column, pieces=True)
    best = short_leaks(words, first, new, seeds) if seeds.short else {}
    at, key = seeds.in_texts(words, first) if len(seeds.keys) else (np.zeros(0, int),) * 2
    order = np.argsort(at, kind="stable")
    at, key = at[order], key[order]
    row, times = np.searchsorted(first, at, "right") - 1, np.diff(seeds.first)[key]
    # As many rows at once as have PLACES places of seeds, one row at least.
    upto = np.cumsum(times)
    edges = np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)] if len(row) else []
    k = 0
    while k + 1 < len(edges):
        start = upto[edges[k] - 1] if edges[k] else 0
        end = max(int(np.searchsorted(upto[np.array(edges[1:]) - 1], start + PLACES, "right")),
                  k + 1)
        mine = slice(edges[k], edges[end])
        _aligned(words, first, seeds, at[mine], key[mine], row[mine], times[mine], threshold,
                 best)
        k = end
    return [(row, item, *found) for (row, item), found in
            sorted(best.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1]))]


def _aligned(words, first, seeds: Seeds, at, key, row, times, threshold: float, best: dict
             ) -> None:
    """Aligns the stretches that the seeds point at; ``best`` gets what reaches the threshold."""
    places = np.repeat(seeds.first[key] - np.cumsum(times) + times, times) + np.arange(times.sum())
    row, at = np.repeat(row, times), np.repeat(at, times)
    item = seeds.item[places]
    sizes = np.array([len(w) for w in seeds.items])
    r, i, low, high = passages(row, item, at - first[row] - seeds.spot[places],
                               seeds.weight[places], sizes)
    start = np.maximum(low - margin(sizes[i]), 0)
    end = np.minimum(high + sizes[i] + margin(sizes[i]), np.diff(first)[r])
    order = np.argsort((end - start) * sizes[i], kind="stable")
    k = 0
    while k < len(order):  # as many pairs at once as fill PAIR_CELLS
        size = 1
        while (k + size < len(order) and size < 1024 and (size + 1)
               * int((end - start)[order[k + size]]) <= PAIR_CELLS // 8):
            size += 1
        some = order[k:k + size]
        k += size
        score, a, z = align([seeds.items[i[x]] for x in some],
                            [words[first[r[x]] + start[x]:first[r[x]] + end[x]] for x in some])
        for n, x in enumerate(some):
            share = float(score[n] / (MATCH * sizes[i[x]]))
            spot = (int(r[x]), int(i[x]))
            if share >= threshold and share > best.get(spot, (0.0,))[0]:
                best[spot] = (share, int(start[x] + a[n]), int(start[x] + z[n]))
