"""Exact substring dedup on bytes by suffix arrays of shards.

Every byte goes that a string of ``width`` bytes (a window) covers which also starts
anywhere else; all its places lose it, the first one too. Windows never cross documents.

1. Anchors. The smallest hash of the ``gram``-byte strings of a window is its key. Equal
   windows have equal keys, and a document's windows fall into runs of one key, about one
   per half window. A run is known by its key and the hash of the bytes it covers.
2. Keys that occur once have no repeats. Runs whose bytes occur twice are repeats as a
   whole. What is left, and one of each class of equal runs beside a different run of the
   same key, are the members: only their windows have to be compared.
3. Shards of members' bytes, in whatever document they stand (bytes that runs have in
   common once): the suffix array by Larsson-Sadakane refinement (groups sorted by their
   first symbols, then by the rank of what stands h further on, h doubling, only groups of
   more than one, piece by piece, later pieces with the ranks that earlier ones have got),
   common prefixes after Kasai, Manzini and Karkkainen (a suffix whose left neighbour byte
   is that of its predecessor follows along the text; only the others are compared).
   Neighbours with ``width`` common bytes are the shard's repeats.
4. Shards are merged: each deals its distinct windows, as sorted runs of 64-bit hashes, to
   hash ranges; runs are merged there pairwise by binary search; a window in two runs is
   a repeat in both.
5. Repeats meet the texts, and the bytes they cover go.

Defined cases: a null text counts as empty (``kept`` is empty); rows are documents, so
rows that repeat a doc_id and text are copies of each other; texts under ``width`` bytes
keep all; ``kept`` is binary, as a cut may fall inside a character; an empty table gives
an empty result; other columns pass.

Scale: one row per run (about 170 bytes of text) in joins on keys and run hashes, where a
hot key or run is one row per task after partial aggregation, or a skewed join that Spark
splits; two shuffles of compressed texts to where their repeats are. A shard sends a blob
to each hash range, many in a batch, as shards and ranges both grow. Shards are cut by
bytes, so no key or passage, however frequent, is a group of its own; a task holds a
shard (or one text). Rows, keys, runs and windows are told apart by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, schema_of, small_batches
from .substring_dedup import pack_small, pack_sorted, unpack_small, unpack_sorted
from .words import _R, _powers, lean, mix, range_hashes, slices, text_bytes

WIDTH, GRAM = 400, 64
SHARD = 2 << 20  # bytes of members
TARGET = 8 << 20  # bytes of texts that meet their repeats at once
RANGE = 1 << 22  # windows of a hash range
BATCH = 1 << 20  # bytes of packed windows sent on at once
LANES = 1024
KEY_BITS = 63  # of group, rank and place in one number
PIECE = 1 << 17  # numbers worked on at once, so that they stay in the processor's cache
RESULT = ("kept", "n_bytes", "n_removed", "n_spans")
_SIGN, _FIRST = np.uint64(1 << 63), np.uint64(56)


def signed(values: np.ndarray) -> np.ndarray:
    return (values ^ _SIGN).view(np.int64)


# --- anchors ---------------------------------------------------------------------------

def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` successive values."""
    n, size = len(values) - width + 1, 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[:n], values[width - size:width - size + n])


def runs_of(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one key: row, first window, number of windows, key, hash of
    the covered bytes, and whether the key's string stands in the run more than once."""
    none = {k: np.zeros(0, np.int64) for k in ("row", "at", "n", "key", "run", "self")}
    span = width - gram + 1  # strings of a window
    if len(data) < width:
        return none
    up, down = _powers(len(data))
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[:len(data)], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[:len(total) - gram])
    low = _sliding(grams, span, np.minimum)
    size = np.diff(at)
    windows = np.maximum(size - width + 1, 0)
    row = np.repeat(np.arange(len(size)), windows)
    if not len(row):
        return none
    begin = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows)
    key = low[begin]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
    n = np.diff(np.r_[new, len(key)])
    first, row, key = begin[new], row[new], key[new]
    # Strings that are the smallest of some window, and the runs they are the key of.
    high = np.zeros(len(low) + 2 * (span - 1), np.uint64)
    high[begin + span - 1] = low[begin]
    place = np.flatnonzero(_sliding(high, span, np.maximum) == grams)
    del high, low
    mine = np.maximum(np.searchsorted(first, place - span + 1, "right") - 1, 0)
    open_ = np.arange(len(place))
    while len(open_):  # some window over the place has its hash as key: go on to its run
        here, spot = mine[open_], place[open_]
        open_ = open_[(key[here] != grams[spot]) | (first[here] + n[here] + span - 1 <= spot)]
        mine[open_] += 1
        open_ = open_[mine[open_] < len(first)]
    times = np.bincount(mine[mine < len(first)], minlength=len(first))
    stop = first + n + width - 1
    run = mix((total[stop] - total[first]) * down[first] ^ mix(n.astype(np.uint64)))
    return {"row": row, "at": first - at[row], "n": n, "key": signed(key), "run": signed(run),
            "self": times > 1}


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """row (hash), at, n, key, run, self of all runs of ``__row, __text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text", PIECE):
                ids = b.column("__row").to_numpy()
                found = runs_of(*text_bytes(b.column("__text")), width, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[found["row"]]), pa.array(found["at"], pa.int64()),
                     pa.array(found["n"], pa.int64()), pa.array(found["key"], pa.int64()),
                     pa.array(found["run"], pa.int64()),
                     pa.array(found["self"].astype(bool))],
                    names=["row", "at", "n", "key", "run", "self"])

    return docs.select("__row", "__text").mapInArrow(
        run, "row long, at long, n long, key long, run long, self boolean")


def suspects(found: DataFrame) -> DataFrame:
    """row, at, n of runs that are repeats as a ``whole``, or ``member`` of a comparison."""
    keys = (found.groupBy("key")
            .agg(F.count(F.lit(1)).alias("times"), F.max("self").alias("self_any"),
                 (F.min("run") < F.max("run")).alias("several"))
            .where("times > 1 or self_any").select("key", "several"))
    left = found.join(keys, "key")
    classes = left.groupBy("run").agg(F.count(F.lit(1)).alias("copies"),
                                      F.min(F.struct("row", "at")).alias("head"))
    return (left.join(classes, "run")
            .select("row", "at", "n", (F.col("copies") > 1).alias("whole"),
                    ((F.col("several") | (F.col("self") & (F.col("copies") == 1)))
                     & (F.struct("row", "at") == F.col("head"))).alias("member"))
            .where("whole or member"))


# --- suffix arrays ----------------------------------------------------------------------

def leading(values: np.ndarray, end: np.ndarray, bits: int, count: int) -> np.ndarray:
    """``count`` values of ``bits`` bits from each position as one big-endian number, zeros
    past its end."""
    n = len(values)
    whole = np.zeros(n, np.uint64)
    for low in range(0, n, PIECE):
        near = values[low:low + PIECE + count].astype(np.uint64)
        size, out, have = 1, None, 0
        while size <= count:  # numbers of 1, 2, 4, ... values, those that count is the sum of
            if count & size:
                out = near if out is None else out << np.uint64(bits * size) | _from(near, have)
                have += size
            size *= 2
            if size <= count:
                near = near << np.uint64(bits * size // 2) | _from(near, size // 2)
        whole[low:low + PIECE] = out[:PIECE]
    room = end - np.arange(n)
    short = np.flatnonzero(room < count)
    past = (bits * (count - room[short])).astype(np.uint64)
    whole[short] = whole[short] >> past << past
    return whole


def _from(values: np.ndarray, k: int) -> np.ndarray:
    """What stands ``k`` further on, zeros at the end."""
    out = np.zeros_like(values)
    out[:max(len(values) - k, 0)] = values[k:]
    return out


def leading_bytes(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one big-endian number, zeros past its end."""
    return leading(data, end, 8, 8)


def leading_symbols(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(the first symbols from each position, how many, bits of one): 0 from its end on, a
    byte's number among the bytes that occur, as few bits each as those need."""
    code = np.cumsum(np.bincount(data, minlength=256) > 0)
    bits = int(code[-1]).bit_length()
    return leading(code.astype(np.uint16)[data], end, bits, 63 // bits), 63 // bits, bits


def pieces(starts: np.ndarray, n: int) -> np.ndarray:
    """Edges of pieces of whole groups, of about PIECE or one group."""
    cut = np.searchsorted(starts, np.arange(PIECE, n, PIECE))
    return np.unique(np.r_[0, starts[cut[cut < len(starts)]], n])


def suffix_array(data: np.ndarray, end: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Positions in the order of the bytes from them to the end of their stretch (a
    stretch's end is smaller than any byte, and ends are ordered as the stretches are)."""
    n, more = len(data), int(stretch[-1]) + 1 if len(stretch) else 0
    if not n:
        return np.zeros(0, np.int64)
    kind = np.int32 if n + more < 1 << 31 else np.int64
    lead, h, bits = leading_symbols(data, end)
    sa = np.argsort(lead)
    lead = lead[sa]
    new = np.r_[True, lead[1:] != lead[:-1]]
    closed = np.flatnonzero(lead & np.uint64((1 << bits) - 1) == 0)  # end within h symbols
    sa[closed] = sa[closed][np.lexsort((sa[closed], lead[closed]))]
    new[closed] = True
    del lead
    # Ranks by place in the text with its ends: a stretch's bytes are moved by its number.
    place = np.arange(n, dtype=kind) + stretch.astype(kind)
    last = np.flatnonzero(np.r_[stretch[1:] != stretch[:-1], True])
    sa = place[sa]
    rank = np.zeros(n + more, kind)
    rank[end[last] + stretch[last]] = stretch[last]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=kind), 0)) + kind(more)
    slot = np.flatnonzero(~(new & np.r_[new[1:], True])).astype(kind)
    here, new, bits = sa[slot], new[slot], (n + more).bit_length()
    while len(slot):  # slots of the array that belong to groups of more than one
        left = []
        edges = pieces(np.flatnonzero(new), len(slot))
        for a, b in zip(edges, edges[1:]):
            spot, at, group = slot[a:b], here[a:b], np.cumsum(new[a:b])
            after, low = rank[at + kind(h)].astype(np.int64), int(b - a).bit_length()
            if low + bits + int(group[-1]).bit_length() <= KEY_BITS:
                both = (group << bits | after) << low | np.arange(b - a)
                both.sort()
                order, both = both & ((1 << low) - 1), both >> low
            else:
                both = group * (n + more) + after
                order = np.argsort(both)
                both = both[order]
            at = at[order]
            fresh = np.r_[True, both[1:] != both[:-1]]
            rank[at] = np.maximum.accumulate(np.where(fresh, spot, 0)) + kind(more)
            sa[spot] = at
            on = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
            left.append((spot[on], at[on], fresh[on]))
        slot, here, new = map(np.concatenate, zip(*left))
        h *= 2
    origin = np.zeros(n + more, kind)
    origin[place] = np.arange(n, dtype=kind)
    return origin[sa]


def shared_bytes(lead: np.ndarray, x: np.ndarray, y: np.ndarray, room: np.ndarray
                 ) -> np.ndarray:
    """Bytes in common from x and from y on, ``room`` at most: eight at a time side by side
    while many go on, then one pair after the other in pieces that double."""
    same = np.zeros(len(x), np.int64)
    going = np.flatnonzero(room > 0)
    while len(going) > LANES:
        differ = lead[x[going] + same[going]] ^ lead[y[going] + same[going]]
        # Leading zero bytes of the difference: the bytes in common.
        bits = np.frexp((differ >> np.uint64(11)).astype(np.float64))[1]
        fits = np.where(differ == 0, 8, np.where(bits > 0, (53 - bits) // 8,
                                                 np.where(differ >> np.uint64(8) > 0, 6, 7)))
        same[going] = np.minimum(same[going] + fits, room[going])
        going = going[(fits == 8) & (same[going] < room[going])]
    for k in going.tolist():
        i, j, at, most, size = int(x[k]), int(y[k]), int(same[k]), int(room[k]), 64
        while at < most:
            stop = min(at + size, most)
            unlike = lead[i + at:i + stop:8] != lead[j + at:j + stop:8]
            if unlike.any():
                at += 8 * int(unlike.argmax())
                differ = int(lead[i + at]) ^ int(lead[j + at])
                at = min(at + (64 - differ.bit_length()) // 8, most)
                break
            at, size = stop, 2 * size
        same[k] = at
    return same


def common_prefixes(lead: np.ndarray, end: np.ndarray, sa: np.ndarray, most: int
                    ) -> np.ndarray:
    """For each slot of a suffix array the bytes (``most`` at most) its suffix has in common
    with the one before. Where the bytes left of both are equal, the suffixes one byte
    before are neighbours too and share one byte more; so only the others are compared
    (their common bytes are 2 n log n together at most), and the rest follows along the
    text."""
    n = len(sa)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    left = np.zeros(n, np.int16)  # the byte before plus 1, 0 where a stretch begins
    left[1:] = lead[:-1] >> _FIRST
    left[1:] += 1
    left[1:][end[1:] != end[:-1]] = 0
    head = np.flatnonzero((left == 0) | (before < 0) | (left[before] != left))
    known = np.zeros(len(head), np.int64)
    for a in range(0, len(head), PIECE):
        x = head[a:a + PIECE]
        y = before[x].astype(np.int64)
        room = np.where(y < 0, 0, np.minimum(end[x] - x, end[y] - y))
        known[a:a + PIECE] = x + shared_bytes(lead, x, y, room)
    known = np.repeat(known, np.diff(np.r_[head, n])) - np.arange(n)
    return np.minimum(known, most)[sa]


class Shard:
    """Stretches of documents: (row, at, bytes, runs of windows to compare)."""

    def __init__(self):
        self.rows: list[int] = []
        self.at: list[int] = []
        self.parts: list[bytes] = []
        self.runs: list[tuple[int, int]] = []
        self.size = 0

    def add(self, row: int, at: int, part: bytes, runs: list[tuple[int, int]]) -> None:
        """``runs``: first and last plus one of the windows, by their place in the text."""
        self.rows.append(row)
        self.at.append(at)
        self.parts.append(part)
        self.runs += [(a - at + self.size, stop - at + self.size) for a, stop in runs]
        self.size += len(part)

    def classes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows in suffix order, the number of each one's class)."""
        self.data = np.frombuffer(b"".join(self.parts), np.uint8)
        size = np.array([len(x) for x in self.parts])
        stop = np.cumsum(size)
        self.stretch = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.row_of = np.array(self.rows, np.int64)
        self.offset = np.array(self.at, np.int64) - (stop - size)
        end = np.repeat(stop, size)
        sa = suffix_array(self.data, end, self.stretch)
        prefix = common_prefixes(leading_bytes(self.data, end), end, sa, width)
        number = np.cumsum(prefix < width)
        wanted = np.zeros(len(self.data), bool)
        for a, b in self.runs:
            wanted[a:b] = True
        windows = np.flatnonzero(wanted[sa])
        return sa[windows], number[windows]

    def places(self, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, at) of positions of the shard."""
        k = self.stretch[spots]
        return self.row_of[k], self.offset[k] + spots


def target_of(row: np.ndarray, targets: int) -> np.ndarray:
    """Where a row's text and repeats meet; SQL's pmod(row, targets)."""
    return (row % targets).astype(np.int32)


def _in_order(*keys: np.ndarray) -> bool:
    """Whether rows are in the order of their keys, the first one first."""
    fine = True
    for k in reversed(keys):
        fine = (k[:-1] < k[1:]) | ((k[:-1] == k[1:]) & fine)
    return bool(np.all(fine))


def pack_places(row: np.ndarray, at: np.ndarray, targets: int) -> list[tuple[int, bytes]]:
    """Places of repeats, one blob per target."""
    import zstandard

    target = target_of(row, targets)
    if not _in_order(target, row, at):
        order = np.lexsort((at, row, target))
        row, at, target = row[order], at[order], target[order]
    cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(row) else []
    out, zipper = [], zstandard.ZstdCompressor(level=1)
    for a, b in zip(cut, np.r_[cut[1:], len(row)].astype(int) if len(row) else []):
        ids, which = np.unique(row[a:b], return_inverse=True)
        body = [ids.tobytes(), pack_small(np.diff(which, prepend=0)), pack_small(at[a:b])]
        out.append((int(target[a]), np.array([len(body[0]), len(body[1])], "<i8").tobytes()
                    + zipper.compress(b"".join(body))))
    return out


def unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    a, b = np.frombuffer(blob, "<i8", 2).tolist()
    body = zstandard.ZstdDecompressor().decompress(blob[16:])
    ids = np.frombuffer(body[:a], np.int64)
    return ids[np.cumsum(unpack_small(body[a:a + b]))], unpack_small(body[a + b:])


# --- merging shards ----------------------------------------------------------------------

def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs of distinct hashes, merged pairwise by binary search: the hashes that
    stand in two of them or more."""
    level, twice = [r for r in runs if len(r)], [np.zeros(0, np.uint64)]
    while len(level) > 1:
        level.sort(key=len)
        after = level[len(level) - len(level) % 2:]
        for b, a in zip(level[::2], level[1::2]):
            at = np.searchsorted(a, b)
            hit = a[np.minimum(at, len(a) - 1)] == b
            twice.append(b[hit])
            add = np.flatnonzero(~hit)
            out, mine = np.empty(len(a) + len(add), np.uint64), np.ones(len(a) + len(add), bool)
            spot = at[add] + np.arange(len(add))
            mine[spot] = False
            out[spot], out[mine] = b[add], a
            after.append(out)
        level = after
    return np.unique(np.concatenate(twice))


SHARED = "part int, hashes binary, alone binary, __target int, __places binary"
SHARED_NAMES = [c.split()[0] for c in SHARED.split(", ")]
PLACES = "__target int, __places binary"


def _shared(part=None, hashes=None, alone=None, target=None, places=None) -> pa.RecordBatch:
    n = len(part if part is not None else target)
    cols = [(part, pa.int32()), (hashes, pa.binary()), (alone, pa.binary()),
            (target, pa.int32()), (places, pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, kind) if x is None else pa.array(x, kind) for x, kind in cols],
        names=SHARED_NAMES)


def shard_rows(shard: Shard, width: int, parts: int, targets: int) -> Iterator[pa.RecordBatch]:
    """A shard's own repeats as places, and its distinct windows dealt to hash ranges."""
    spot, number = shard.classes(width)
    if not len(spot):
        return
    new = np.r_[True, number[1:] != number[:-1]]
    alone = new & np.r_[new[1:], True]
    own = pack_places(*shard.places(np.sort(spot[~alone])), targets)
    if own:
        yield _shared(target=[t for t, _ in own], places=[p for _, p in own])
    spot, alone = spot[new], alone[new]
    hashes = range_hashes(shard.data, spot, spot + width)
    order = np.argsort(hashes)
    spot, hashes, alone = spot[order], hashes[order], alone[order]
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    cut = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    held, size = [], 0
    for a, b in zip(cut, cut[1:]):
        row, at = shard.places(spot[a:b][alone[a:b]])
        ids, which = np.unique(row, return_inverse=True)
        body = [ids.tobytes(), np.packbits(alone[a:b]).tobytes(), pack_small(which),
                pack_small(at)]
        held.append((int(part[a]), pack_sorted(hashes[a:b]),
                     np.array([*map(len, body)], "<i8").tobytes() + b"".join(body)))
        size += len(held[-1][1]) + len(held[-1][2])
        if size >= BATCH:  # many ranges to a batch: their number grows with the input
            yield _shared(*zip(*held))
            held, size = [], 0
    if held:
        yield _shared(*zip(*held))


def alone_places(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which entries are alone in their shard, their rows, their places)."""
    edges = np.r_[0, np.cumsum(np.frombuffer(blob, "<i8", 4))].astype(int) + 32
    ids, flags, which, at = (blob[a:b] for a, b in zip(edges, edges[1:]))
    alone = np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)
    return alone, np.frombuffer(ids, np.int64)[unpack_small(which)], unpack_small(at)


def _overlapping(runs: list, width: int) -> list[list]:
    """Runs of windows whose bytes overlap, together: those are sorted once."""
    out: list[list] = []
    for run in runs:
        if out and run[0] < out[-1][-1][1] + width - 1:
            out[-1].append(run)
        else:
            out.append([run])
    return out


def compared(members: DataFrame, texts: DataFrame, width: int, parts: int, targets: int
             ) -> DataFrame:
    """Packed places of the repeats among the members' windows, by target."""
    names = ["__target", "__row", "at", "n", "__zip"]
    both = (members.withColumn("__row", F.col("row")).unionByName(texts, allowMissingColumns=True)
            .select(*names).repartitionById(targets, F.col("__target"))
            .sortWithinPartitions("__row", F.col("__zip").isNotNull(), "at"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lean()
        unzip, shard, row, wanted = zstandard.ZstdDecompressor(), Shard(), None, []
        for b in batches:  # a row's members come before its text
            rows, ats, ns, zips = (b.column(c).to_pylist() for c in names[1:])
            for r, at, n, z in zip(rows, ats, ns, zips):
                if r != row:
                    row, wanted = r, []
                if z is None:
                    if wanted and wanted[-1][1] >= at:  # runs side by side are one stretch
                        wanted[-1][1] = max(wanted[-1][1], at + n)
                    else:
                        wanted.append([at, at + n])
                elif wanted:
                    raw = unzip.decompress(z)
                    for runs in _overlapping(wanted, width):
                        a, stop = runs[0][0], runs[-1][1] + width - 1
                        shard.add(row, a, raw[a:stop], runs)
                    if shard.size >= SHARD:
                        yield from shard_rows(shard, width, parts, targets)
                        shard = Shard()
        if shard.size:
            yield from shard_rows(shard, width, parts, targets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        part, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            runs = [unpack_sorted(h) for h, _ in held]
            twice = merged_runs([r[np.r_[True, r[1:] != r[:-1]]]  # a run may hold collisions
                                 for r in runs])
            row, at = [], []
            for hashes, (_, blob) in zip(runs, held):
                spot = np.minimum(np.searchsorted(twice, hashes), max(len(twice) - 1, 0))
                hit = twice[spot] == hashes if len(twice) else np.zeros(len(hashes), bool)
                alone, rows, places = alone_places(blob, len(hashes))
                row.append(rows[hit[alone]])
                at.append(places[hit[alone]])
            if row:
                found = pack_places(np.concatenate(row), np.concatenate(at), targets)
                if found:
                    yield _places(*zip(*found))

        for b in batches:
            for p, hashes, alone, target, places in zip(*(b.column(c).to_pylist()
                                                          for c in SHARED_NAMES)):
                if places is not None:
                    yield _places([target], [places])
                    continue
                if p != part and held:
                    yield from done()
                    held.clear()
                part = p
                held.append((hashes, alone))
        yield from done()

    return (both.mapInArrow(build, SHARED)
            .repartitionById(parts, F.coalesce("part", F.col("__target") % parts))
            .sortWithinPartitions("part").mapInArrow(merge, PLACES))


def _places(target, places) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(target, pa.int32()), pa.array(places, pa.binary())],
        names=["__target", "__places"])


# --- removal -----------------------------------------------------------------------------

class Repeats:
    """What repeats in the rows of a target: runs of windows, and windows by themselves."""

    def __init__(self):
        self.runs: list[tuple] = []
        self.found: tuple | None = None

    def add(self, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        self.runs.append((row, at, n))

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        if self.found is None:
            none = (np.zeros(0, np.int64),) * 3
            rows, at, n = map(np.concatenate, zip(none, *self.runs))
            order = np.argsort(rows, kind="stable")
            self.found, self.runs = (rows[order], at[order], n[order]), []
        a, b = np.searchsorted(self.found[0], row), np.searchsorted(self.found[0], row, "right")
        return self.found[1][a:b], self.found[2][a:b]


def without_repeats(raw: bytes, at: np.ndarray, n: np.ndarray, width: int
                    ) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs)."""
    if not len(at):
        return raw, 0, 0
    cover = np.zeros(len(raw) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n + width - 1, -1)
    gone = np.cumsum(cover)[:len(raw)] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def zipped_texts(docs: DataFrame, columns: list[str], targets: int) -> DataFrame:
    """``columns``, ``__row``, and the text as ``__zip`` at the row's target."""
    src = docs.select(*columns, "__row", "__text")
    schema = schema_of(docs.select(*columns, "__row"), "__target int, __zip binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zipper = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for b in slices(whole, "__text"):
                row = b.column("__row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(target_of(row, targets)),
                     pa.array([zipper.compress(x) for x in
                               b.column("__text").cast(pa.binary()).to_pylist()], pa.binary())],
                    names=schema.names)

    return src.mapInArrow(run, schema)


def suffix_array_dedup(docs: DataFrame, width: int = WIDTH, text: str = "text",
                       doc_id: str = "doc_id", range_windows: int = RANGE,
                       target_bytes: int = TARGET) -> DataFrame:
    """All columns but the text, the bytes that stay as ``kept`` (binary), ``n_bytes`` of
    the text, ``n_removed`` bytes and ``n_spans``, the maximal runs of removed bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix-arrays")
    gram = max(1, min(GRAM, width // 4))
    columns = [c for c in docs.columns if c not in (text, *RESULT)]
    src = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"),
                      F.xxhash64(F.col(doc_id), F.col(text)).alias("__row"))
    size = src.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    targets = max(1, -(-size // target_bytes))
    found = scratch.write(anchors(src, width, gram), "runs")
    known = scratch.write(suspects(found).withColumn(
        "__target", F.pmod("row", F.lit(targets)).cast("int")), "suspects")
    scratch.drop("runs")
    members = known.where("member").select("row", "at", "n", "__target")
    parts = max(1, -(-(members.agg(F.sum("n")).first()[0] or 0) // range_windows))
    places = scratch.write(compared(members, zipped_texts(src, [], targets), width, parts,
                                    targets), "places")
    whole = known.where("whole").select(F.col("row").alias("__r"), F.col("at").alias("__at"),
                                        F.col("n").alias("__n"), "__target")
    both = (whole
            .unionByName(places, allowMissingColumns=True)
            .unionByName(zipped_texts(src, columns, targets), allowMissingColumns=True)
            .repartitionById(targets, F.col("__target"))
            .sortWithinPartitions("__target", F.col("__zip").isNotNull()))
    schema = schema_of(docs.select(*columns),
                       "kept binary, n_bytes long, n_removed long, n_spans long")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lean()
        unzip, repeats = zstandard.ZstdDecompressor(), Repeats()
        for b in batches:  # repeats come before texts
            is_text = b.column("__zip").is_valid()
            for x in b.filter(b.column("__places").is_valid()).column("__places").to_pylist():
                row, at = unpack_places(x)
                repeats.add(row, at, np.ones(len(at), np.int64))
            runs = b.filter(b.column("__r").is_valid())
            if runs.num_rows:
                repeats.add(*(runs.column(c).to_numpy() for c in ("__r", "__at", "__n")))
            rows = b.filter(is_text)
            if not rows.num_rows:
                continue
            raws = [unzip.decompress(z) for z in rows.column("__zip").to_pylist()]
            out = [without_repeats(raw, *repeats.of(r), width)
                   for raw, r in zip(raws, rows.column("__row").to_pylist())]
            cols = {"kept": pa.array([x for x, _, _ in out], pa.binary()),
                    "n_bytes": pa.array([len(x) for x in raws], pa.int64()),
                    "n_removed": pa.array([x for _, x, _ in out], pa.int64()),
                    "n_spans": pa.array([x for _, _, x in out], pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [cols[c] if c in cols else rows.column(c) for c in schema.names],
                names=schema.names)

    return both.mapInArrow(remove, schema)
