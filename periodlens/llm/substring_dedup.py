"""Substring dedup by prefix-partitioned suffix trees.

A suffix starts at every word that has ``width`` words to go. Suffixes are split by
variable-length word prefixes: a branch with too many suffixes for one group is
extended by a further word, so that groups fit in memory. Of a group's subtree only the
nodes at depth ``width`` are made: suffixes that share their first ``width`` words meet in
one node, and a node with more than one leaf is a repeat. (Nothing above or below that
depth is needed for the result, and no node is branched further: repeats longer than
``width`` show as runs of places.) A node's first leaf by (doc_id, place) stays; runs of
other leaves are the repeated stretches, which are removed.

Nodes are known by 64-bit hashes of their path, so suffixes travel as sorted arrays
of hashes and places, packed per slice of rows and group: about 9 bytes a suffix. A
slice sends each path once, with its first place there: a passage that a third of
all documents hold adds one entry per slice, not one per document.

Defined cases: null and empty texts have no words; texts under ``width`` words keep
all; rows of one doc_id count as one document, so exact repeats stand at the same
place, neither is earlier, and both are judged alike; null doc_ids count as one
document after all others; an empty table gives an empty result; other columns pass.

Scale: one pass over the texts per level of the prefix tree (two or three), one for
the suffixes, and one shuffle of the compressed texts to their repeats, by document.
The number of groups follows the suffixes; the driver holds at most four heavy branches
per group and level.
The result depends on the rows alone, not on how they are split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import schema_of, send
from .words import (lean, mix, range_hashes, slices, text_bytes, window_hashes, window_starts,
                    word_bounds)
from .zipped import zipped

WIDTH = 20
GROUP_SUFFIXES = 2_000_000
SLICE = 1 << 22
CODE_BITS = 10  # of a word's hash in a prefix
CODES = 1 << CODE_BITS
LEVELS = 4  # of words in a prefix; a branch still too large is split by whole paths
HELD_BRANCHES = 1 << 20
LAST_ID = np.iinfo(np.int64).max


class PrefixTree:
    """Branches (node * CODES + code of the next word) with too many suffixes for a group,
    sorted, and the node that extends each one; 0 where its suffixes are dealt by whole
    paths. All other branches go to groups by their hash."""

    def __init__(self, groups: int = 1):
        self.groups = groups
        self.heavy, self.node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.nodes = 1

    def extend(self, branches: np.ndarray, by_path: bool = False) -> None:
        new = np.arange(self.nodes, self.nodes + len(branches))
        self.nodes += 0 if by_path else len(branches)
        heavy = np.concatenate([self.heavy, branches])
        node = np.concatenate([self.node, new * (not by_path)])
        order = np.argsort(heavy)
        self.heavy, self.node = heavy[order], node[order]

    def branches(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The branch at which the prefix of each suffix ends, and whether it is dealt by
        path."""
        out, by_path = codes[begin].astype(np.int64), np.zeros(len(begin), bool)
        moving, k = np.arange(len(begin)), 1
        while len(moving) and len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, out[moving]), len(self.heavy) - 1)
            hit = self.heavy[at] == out[moving]
            moving, node = moving[hit], self.node[at[hit]]
            by_path[moving[node == 0]] = True
            moving, node = moving[node > 0], node[node > 0]
            out[moving] = node * CODES + codes[begin[moving] + k]
            k += 1
        return out, by_path

    def group_of(self, codes: np.ndarray, begin: np.ndarray, path: np.ndarray) -> np.ndarray:
        branch, by_path = self.branches(codes, begin)
        key = np.where(by_path, path ^ np.uint64(7), branch.view(np.uint64))
        return (mix(key) % np.uint64(self.groups)).astype(np.int64)


def word_codes(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CODE_BITS)).astype(np.int64)


def branch_counts(docs: DataFrame, tree: PrefixTree, width: int, from_node: int) -> DataFrame:
    """branch, n: suffixes at each branch of the nodes from ``from_node`` on."""
    sent = send(docs.sparkSession, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = sent(), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

        for b in (part for whole in batches for part in slices(whole, "__text")):
            data, at = text_bytes(b.column(0))
            starts, ends, first = word_bounds(data, at)
            begin = window_starts(first, width)
            branch = known.branches(word_codes(range_hashes(data, starts, ends)), begin)[0]
            held.append(np.unique(branch[branch >= from_node * CODES], return_counts=True))
            size += len(held[-1][0])
            if size > HELD_BRANCHES:
                held, size = [summed()], 0
        if held:
            branch, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(branch), pa.array(n)], names=["branch", "n"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return (texts.mapInArrow(run, "branch long, n long")
            .groupBy("branch").agg(F.sum("n").alias("n")))


def grow_tree(docs: DataFrame, width: int = WIDTH, fits: int = GROUP_SUFFIXES) -> PrefixTree:
    """Extends the branches above a quarter of a group, level by level. Spark sums the
    suffixes of branches; the driver gets the heavy ones alone, at most four per group and
    level. Groups hold a third of ``fits`` on average, as hashing deals them unevenly."""
    first = {r["branch"]: r["n"] for r in branch_counts(docs, PrefixTree(), width, 0).collect()}
    tree = PrefixTree(max(1, -(-3 * sum(first.values()) // fits)))
    heavy = [b for b, n in first.items() if 4 * n > fits]
    for level in range(2, LEVELS + 1):
        if not heavy:
            return tree
        from_node = tree.nodes
        tree.extend(np.array(sorted(heavy)))
        counts = branch_counts(docs, tree, width, from_node).where(F.col("n") * 4 > fits)
        heavy = [r["branch"] for r in counts.collect()]
    tree.extend(np.array(sorted(heavy), np.int64), by_path=True)
    return tree


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values: high bits as steps in unary, low bits as whole bytes."""
    n = len(values)
    low = min(8, -(-(64 - max(n.bit_length() - 1, 0)) // 8))
    high = values >> np.uint64(8 * low) if low < 8 else np.zeros(n, np.uint64)
    unary = np.zeros(int(high[-1]) + n if n else 0, np.uint8)
    unary[high.astype(np.int64) + np.arange(n)] = 1
    body = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low]
    return (np.array([n, low], "<u4").tobytes() + np.ascontiguousarray(body.T).tobytes()
            + np.packbits(unary).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, low = np.frombuffer(blob, "<u4", 2).astype(int)
    body = np.zeros((n, 8), np.uint8)
    body[:, :low] = np.frombuffer(blob, np.uint8, n * low, 8).reshape(low, n).T
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + n * low)))[:n]
    high = (ones - np.arange(n)).astype(np.uint64)
    values = body.view("<u8").ravel()
    return values | (high << np.uint64(8 * low)) if low < 8 else values


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes each as the largest needs."""
    values = values.astype("<u8")
    size = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    body = values.view(np.uint8).reshape(-1, 8)[:, :size]
    return bytes([size]) + np.ascontiguousarray(body.T).tobytes()


def unpack_small(blob: bytes) -> np.ndarray:
    size = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(size, -1)
    body = np.zeros((planes.shape[1], 8), np.uint8)
    body[:, :size] = planes.T
    return body.view("<u8").ravel().astype(np.int64)


def _check(path: np.ndarray) -> np.ndarray:
    return (path >> np.uint64(48)).astype(np.uint16).view(np.int16)


PACKED = ("part int, group int, path binary, spot binary, docs binary, begun binary, "
          "__target int, __repeats binary")
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
REPEATS = "__target int, __repeats binary"


def target_of(doc: np.ndarray, targets: int) -> np.ndarray:
    """The part of the documents that a doc_id belongs to when repeats meet texts."""
    return (mix(doc.astype(np.uint64)) % np.uint64(targets)).astype(np.int32)


def pack_repeats(doc: np.ndarray, place: np.ndarray, path: np.ndarray, targets: int
                 ) -> tuple[list[int], list[bytes]]:
    """Repeated places (with a check of their path) in one blob per target."""
    import zstandard

    target = target_of(doc, targets)
    order = np.lexsort((place, doc, target))
    doc, place, target = doc[order], place[order], target[order]
    check = _check(path[order])
    cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(doc) else []
    blobs, zipper = [], zstandard.ZstdCompressor(level=1)
    for a, b in zip(cut, np.r_[cut[1:], len(doc)].astype(int) if len(doc) else []):
        ids = pack_small(np.diff(doc[a:b], prepend=doc[a:a + 1]))
        spots = pack_small(place[a:b])
        head = np.array([doc[a], len(ids), len(spots)], "<i8").tobytes()
        blobs.append(head + zipper.compress(ids + spots + check[a:b].tobytes()))
    return [int(target[a]) for a in cut], blobs


def unpack_repeats(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, place, check."""
    import zstandard

    start, n_ids, n_spots = np.frombuffer(blob, "<i8", 3)
    body = zstandard.ZstdDecompressor().decompress(blob[24:])
    return (start + np.cumsum(unpack_small(body[:n_ids])),
            unpack_small(body[n_ids:n_ids + n_spots]).astype(np.int32),
            np.frombuffer(body, np.int16, offset=int(n_ids + n_spots)))


def pack_slice(batch: pa.RecordBatch, tree: PrefixTree, parts: int, targets: int, width: int
               ) -> Iterator[pa.RecordBatch]:
    """A slice's distinct paths at their first places, packed by group, and the
    places that come after the first within the slice, as repeats already known."""
    doc = batch.column("doc_id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    order = np.argsort(doc, kind="stable")
    if (order[1:] < order[:-1]).any():
        batch, doc = batch.take(pa.array(order)), doc[order]
    words, rows, place, path, codes, base = [], [], [], [], [], 0
    for b in slices(batch, "__text"):
        data, at = text_bytes(b.column("__text"))
        starts, ends, first = word_bounds(data, at)
        hashes = range_hashes(data, starts, ends)
        begin = window_starts(first, width)
        row = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(first) - width + 1, 0))
        codes_here = word_codes(hashes)
        here = window_hashes(hashes, width)[begin] if len(begin) else np.zeros(0, np.uint64)
        path.append(here)
        codes.append(tree.group_of(codes_here, begin, here).astype(np.int32))
        place.append((begin - first[row]).astype(np.int32))
        rows.append((row + base).astype(np.int32))
        words.append(np.maximum(np.diff(first) - width + 1, 0))
        base += len(at) - 1
    if not path or not sum(map(len, path)):
        return
    path, group, place, row = map(np.concatenate, (path, codes, place, rows))
    del codes, rows
    begun = np.concatenate([[0], np.cumsum(np.concatenate(words))])[:-1]
    # Rows of one doc_id are one document: order by place among them.
    order = np.argsort(path, kind="stable").astype(np.int32)
    same = np.zeros(len(order), bool)
    same[1:] = path[order[1:]] == path[order[:-1]]
    if len(np.unique(doc)) < len(doc) and same.any():
        order = np.lexsort((place, doc[row], path))
    firsts = order[~same]
    # Repeated rows of one doc_id share their places: those are no repeats.
    again, head = order[same], firsts[np.cumsum(~same)[same] - 1]
    repeats = again[(doc[row[again]] != doc[row[head]]) | (place[again] != place[head])]
    del again, head, same, order
    if len(repeats):
        target, blobs = pack_repeats(doc[row[repeats]], place[repeats], path[repeats], targets)
        none = pa.nulls(len(blobs), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([t % parts for t in target], pa.int32()),
             pa.nulls(len(blobs), pa.int32()), none, none, none, none,
             pa.array(target, pa.int32()), pa.array(blobs, pa.binary())], names=PACKED_NAMES)
    firsts = firsts[np.argsort(group[firsts], kind="stable")]  # by path within a group
    groups, cut = np.unique(group[firsts], return_index=True)
    for g, a, b in zip(groups, cut, np.r_[cut[1:], len(firsts)]):
        mine = firsts[a:b]
        used = np.unique(row[mine])
        spot = np.searchsorted(used, row[mine])
        ids = doc[used]
        # A place is its number among the suffixes of the rows used here.
        size = np.concatenate([[0], np.cumsum(np.concatenate(words)[used])])
        yield pa.RecordBatch.from_arrays(
            [pa.array([g % parts], pa.int32()), pa.array([g], pa.int32()),
             pa.array([pack_sorted(path[mine])], pa.binary()),
             pa.array([pack_small(size[spot] + place[mine])], pa.binary()),
             pa.array([pack_small(np.diff(ids, prepend=ids[:1]))], pa.binary()),
             pa.array([ids[:1].tobytes() + pack_small(np.diff(size))], pa.binary()),
             pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=PACKED_NAMES)


def subtree_repeats(blobs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, place and path of the leaves of a group's deep nodes, but the first of each."""
    path, doc, place = [], [], []
    for blob in blobs:
        paths = unpack_sorted(blob["path"])
        size = np.concatenate([[0], np.cumsum(unpack_small(blob["begun"][8:]))])
        ids = np.frombuffer(blob["begun"], np.int64, 1)[0] + np.cumsum(unpack_small(blob["docs"]))
        spot = unpack_small(blob["spot"])
        row = np.searchsorted(size, spot, "right") - 1
        path.append(paths)
        doc.append(ids[row])
        place.append((spot - size[row]).astype(np.int32))
    path, doc, place = map(np.concatenate, (path, doc, place))
    order = np.argsort(path, kind="stable")
    same = path[order][1:] == path[order][:-1]
    inner = np.zeros(len(order) + 1, bool)
    inner[1:-1] = same
    deep = order[inner[1:] | inner[:-1]]  # leaves that share a node with another
    path, doc, place = path[deep], doc[deep], place[deep]
    order = np.lexsort((place, doc, path))
    path, doc, place = path[order], doc[order], place[order]
    new = np.ones(len(path), bool)
    new[1:] = path[1:] != path[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(path)), 0))
    later = (doc != doc[head]) | (place != place[head])
    return doc[later], place[later], path[later]


def repeats(docs: DataFrame, tree: PrefixTree, targets: int, width: int = WIDTH) -> DataFrame:
    """target and packed repeats: all starts of windows of ``width`` words whose words
    also start earlier, one row per group (or slice) and target."""
    sent, groups = send(docs.sparkSession, tree), tree.groups
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for whole in batches:
            for b in slices(whole, "__text", SLICE):
                yield from pack_slice(b, known, groups, targets, width)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                target, blobs = pack_repeats(*subtree_repeats(held), targets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target, pa.int32()), pa.array(blobs, pa.binary())],
                    names=PACKED_NAMES[6:])

        for b in batches:
            known = b.filter(pc.is_valid(b.column("__target")))
            if known.num_rows:
                yield known.select(PACKED_NAMES[6:])
            for blob in b.filter(pc.is_valid(b.column("group"))).select(
                    PACKED_NAMES[1:6]).to_pylist():
                if held and held[0]["group"] != blob["group"]:
                    yield from done()
                    held.clear()
                held.append(blob)
        yield from done()

    return (src.mapInArrow(pack, PACKED).repartitionById(groups, F.col("part"))
            .sortWithinPartitions("group").mapInArrow(build, REPEATS))


class KnownRepeats:
    """The repeats of a target's documents, by doc_id."""

    def __init__(self):
        self.parts: list = []
        self.found: tuple | None = None

    def add(self, blobs: list[bytes]) -> None:
        self.parts += [unpack_repeats(x) for x in blobs]
        self.found = None

    def of(self, doc: int) -> tuple[np.ndarray, np.ndarray]:
        """places, checks."""
        if self.found is None:
            empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16))
            doc_, place, check = map(np.concatenate, zip(empty, *self.parts))
            order = np.argsort(doc_, kind="stable")
            self.found = doc_[order], place[order], check[order]
            self.parts = [self.found]
        a, b = np.searchsorted(self.found[0], [doc, doc + 1] if doc < LAST_ID else [doc, doc])
        b = b if doc < LAST_ID else len(self.found[0])
        return self.found[1][a:b], self.found[2][a:b]


def substring_dedup(docs: DataFrame, width: int = WIDTH, group: int = GROUP_SUFFIXES
                    ) -> DataFrame:
    """All columns; ``text`` holds the kept words joined by one space where words were
    removed (null texts stay null), ``n_words`` and ``n_removed`` count words."""
    tree = grow_tree(docs, width, group)
    # Texts and repeats meet by parts of about one group's words.
    targets = tree.groups
    found = repeats(docs, tree, targets, width)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    small = zipped(docs.select(*columns), more="__target int", also=lambda b: [pa.array(
        target_of(b.column("doc_id").fill_null(LAST_ID).to_numpy(zero_copy_only=False), targets))])
    # A target's repeats come before its texts.
    both = (found.withColumn("__text", F.lit(False))
            .unionByName(small.withColumn("__text", F.lit(True)), allowMissingColumns=True)
            .repartitionById(targets, F.col("__target")).sortWithinPartitions("__text"))
    schema = schema_of(docs.select(*columns), "n_words long, n_removed long")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lean()
        unzip, known = zstandard.ZstdDecompressor(), KnownRepeats()
        for b in batches:
            rows = b.filter(b.column("__text"))
            if rows.num_rows < b.num_rows:
                known.add([x for x in b.column("__repeats").to_pylist() if x is not None])
            texts, n_words, n_removed = [], [], []
            for z, doc in zip(rows.column("__zip").to_pylist(),
                              rows.column("doc_id").to_pylist()):
                raw = None if z is None else unzip.decompress(z)
                kept, n, gone = without_repeats(
                    raw, *known.of(int(LAST_ID) if doc is None else doc), width)
                texts.append(kept)
                n_words.append(n)
                n_removed.append(gone)
            cols = {"text": pa.array(texts, pa.binary()).cast(pa.string()),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [cols[c] if c in cols else rows.column(c) for c in schema.names],
                names=schema.names)

    return both.mapInArrow(remove, schema)


def without_repeats(raw: bytes | None, at: np.ndarray, want: np.ndarray, width: int
                    ) -> tuple[bytes | None, int, int]:
    """(text, words, removed words): a place counts where the path there agrees."""
    words = raw.split() if raw else []
    if not len(at) or not words:
        return raw, len(words), 0
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(raw)]))
    path = window_hashes(range_hashes(data, starts, ends), width)
    ok = at < len(path)
    at, want = at[ok], want[ok]
    at = at[_check(path[at]) == want]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    gone = np.cumsum(cover)[:len(words)] > 0
    if not gone.any():
        return raw, len(words), 0
    return (b" ".join(w for w, g in zip(words, gone) if not g), len(words), int(gone.sum()))


def joined_words(text: str) -> Column:
    """The words of a text joined by one space; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")),
                                   r"[\x20\x09-\x0D]+", " "))
