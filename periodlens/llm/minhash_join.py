"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set are its distinct shingles of ``SHINGLE`` successive words (A-Z
lower-cased; with fewer words the whole sequence; without words none). Documents of
equal sets are one class. Each class has a signature of ``COORDINATES`` minima.

1. Classes are posted under coordinate-value pairs. Two classes that agree in
   ``matches`` coordinates share one of the first ``COORDINATES - matches + 1`` of each
   in any common order of the pairs, so only that prefix is posted, rare pairs first.
2. A list's members are merged: one member's collisions with all members not yet
   merged are counted at once over all coordinates; those with ``matches`` or more are
   merged and skipped from then on. What leaves a list is one edge per merged member.
3. Components of these edges are the candidate groups. Within a group, the classes'
   full sets are compared in the same manner: links are pairs with
   100 * intersection >= ``percent`` * union, by count of common shingles.
4. Components of the links give each document the smallest doc_id it reaches.

``percent`` sets ``matches``: the most that a link at that very similarity falls short of
with a probability of at most ``MISSED``. At 0.85 that is 40 of 64 (2.4e-6; 1.6e-7 at
0.87), at 0.80 it is 35 (1.2e-6); a component is lost only with its last path.

Defined cases: null and empty texts are linked with nothing; equal sets are linked;
rows with one doc_id count as one document in links, and exact repeats are all kept
with it; a null doc_id is linked with nothing and kept, with a null component; an
empty table gives an empty result; other columns pass where ``keep`` names them.

Scale: exact copies are one class before any posting. Lists longer than ``LIST`` and
groups with more than ``GROUP_SHINGLES`` shingles are dealt out in blocks, every pair
of blocks to a task of its own: no pair is left out, and no task holds more than two
blocks. Pairs are never written out; only edges that merge are, one per member."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, schema_of
from .sorted_groups import binary_matrix, sorted_groups
from .words import mix, range_hashes, slices, text_bytes, window_hashes, window_starts, word_bounds
from .zipped import unzipped, zipped

SHINGLE, PERCENT = 5, 85
COORDINATES, MISSED = 64, 2.5e-6
LIST = 4096
GROUP_SHINGLES = 2_000_000
CELLS = 1 << 16
SALTS = 64  # parts in which rows meet the names of large groups


def matches_for(percent: int) -> int:
    """The most coordinates that links at ``percent`` miss with at most ``MISSED``."""
    p, short = percent / 100, 0.0
    for m in range(COORDINATES):
        short += comb(COORDINATES, m) * p ** m * (1 - p) ** (COORDINATES - m)
        if short > MISSED:
            return m
    return COORDINATES


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of row i are hashes[first[i]:first[i + 1]],
    sorted."""
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends, first = word_bounds(lower, at)
    words = range_hashes(lower, starts, ends)
    n = np.diff(first)
    begin = window_starts(first, SHINGLE)
    hashes = window_hashes(words, SHINGLE)[begin] if len(begin) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(n)), np.maximum(n - SHINGLE + 1, 0))
    short = [(i, window_hashes(words[first[i]:first[i + 1]], int(n[i])))
             for i in np.flatnonzero((n > 0) & (n < SHINGLE))]
    if short:
        hashes = np.concatenate([hashes, *[h for _, h in short]])
        row = np.concatenate([row, [i for i, _ in short]])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(n) + 1))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, COORDINATES, np.uint64))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima by row and coordinate, 0 for rows without shingles."""
    full = np.flatnonzero(first[1:] > first[:-1])
    out = np.zeros((len(first) - 1, COORDINATES), np.uint32)
    if len(full):
        for k, (a, b) in enumerate(zip(*_constants())):
            out[full, k] = np.minimum.reduceat((hashes * a + b) >> np.uint64(32), first[full])
    return out


def with_signatures(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns, n_shingles, the set's digest (d1, d2) and its signature."""
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = schema_of(docs.select(*keep), "n_shingles long, d1 long, d2 long, sig binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "__text")):
            hashes, first = shingle_sets(*text_bytes(b.column("__text")))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(s)))])
                    for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            d1, d2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
            sig = [x.tobytes() for x in signatures(hashes, first)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.diff(first), pa.int64()), pa.array(d1),
                 pa.array(d2), pa.array(sig, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def _keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per class, coordinate and value."""
    coordinate = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    return mix(sig.astype(np.uint64) | coordinate)


def _sig_matrix(column) -> np.ndarray:
    return binary_matrix(column, COORDINATES, np.uint32)


def cell_counts(classes: DataFrame) -> np.ndarray:
    """How many keys fall into each of CELLS cells: rarer cells come first in prefixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            keys = _keys(_sig_matrix(b.column("sig")))
            counts += np.bincount((keys >> np.uint64(48)).ravel().astype(np.int64),
                                  minlength=CELLS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])],
                                         names=["cell", "n"])

    rows = (classes.select("sig").mapInArrow(run, "cell long, n long")
            .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """key, id of every class under each key of its prefix that others share."""
    cells = classes.sparkSession.sparkContext.broadcast(cell_counts(classes))
    size = COORDINATES - matches + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(_sig_matrix(b.column("sig")))
            often = cells.value[(keys >> np.uint64(48)).astype(np.int64)]
            first = np.lexsort((keys, often), axis=1)[:, :size]
            keys = np.take_along_axis(keys, first, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)),
                 pa.array(np.repeat(b.column("id").to_numpy(), size))], names=["key", "id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for b in batches:  # the last row waits for its successor
            key = np.concatenate([key, b.column("key").to_numpy()])
            ids = np.concatenate([ids, b.column("id").to_numpy()])
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            many = np.r_[open_, same] | np.r_[same, False]
            yield _pairs(key[:-1][many[:-1]], ids[:-1][many[:-1]])
            open_ = bool(same[-1]) if len(same) else open_
            key, ids = key[-1:], ids[-1:]
        if open_:
            yield _pairs(key, ids)

    return (classes.select("id", "sig").mapInArrow(post, "key long, id long")
            .repartition("key").sortWithinPartitions("key")
            .mapInArrow(shared, "key long, id long"))


def _pairs(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["key", "id"])


def in_blocks(rows: DataFrame, key: str, large: DataFrame, member: str = "id") -> DataFrame:
    """``rows`` with columns i and j: groups named in ``large`` (key, blocks) are dealt
    into blocks by member, and each row goes to every pair of blocks with its own. Rows
    meet the large groups' names in ``SALTS`` parts by member, so that a group is never in
    one task before it is dealt."""
    salt = F.pmod(F.xxhash64(member, F.lit(1)), F.lit(SALTS)).cast("int")
    spread = (large.select(key, F.col("blocks").cast("long"))
              .withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    own = F.pmod(F.xxhash64(member), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other:
                        F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    return (rows.withColumn("__s", salt).join(spread, [key, "__s"], "left")
            .withColumn("__b", F.explode(F.when(F.col("blocks").isNotNull(), pairs)
                                         .otherwise(alone)))
            .select(*rows.columns, "__b.i", "__b.j"))


def merge_members(n: int, matches) -> np.ndarray:
    """Numbers the connected groups of n members. ``matches(x, rest)`` tells which of
    the members ``rest`` match x; merged members are skipped from then on."""
    label = np.full(n, -1)
    rest = np.arange(n)
    while len(rest):
        todo = [rest[0]]
        label[rest[0]] = rest[0]
        rest = rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = matches(x, rest)
            found = rest[hit]
            if len(found):
                label[found] = label[x]
                todo.extend(found.tolist())
                rest = rest[~hit]
    return label


def list_edges(posted: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """a, b: merged members of the lists, each with the first of its merge."""
    large = (posted.groupBy("key").count().where(F.col("count") > LIST)
             .select("key", F.ceil(F.col("count") / LIST).alias("blocks")))
    rows = in_blocks(posted, "key", large).join(classes.select("id", "sig"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in sorted_groups(batches, ["key", "i", "j"]):
            ids = table.column("id").to_numpy()
            sig = _sig_matrix(table.column("sig"))
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= matches]
            a, b = [ids[two]], [ids[two + 1]]
            for s, e in zip(edges[:-1][size > 2], edges[1:][size > 2]):
                mine = sig[s:e]
                label = merge_members(e - s, lambda x, rest: (mine[rest] == mine[x]).sum(axis=1)
                                      >= matches)
                merged = np.flatnonzero(label != np.arange(e - s))
                a.append(ids[s:e][merged])
                b.append(ids[s:e][label[merged]])
            yield _edge_batch(np.concatenate(a), np.concatenate(b))

    return (rows.select("key", "i", "j", "id", "sig").repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j", "id").mapInArrow(run, "a long, b long"))


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                      names=["a", "b"])


class CommonShingles:
    """Counts the shingles that one member has in common with each of the others. The
    index covers the members not yet merged and is rebuilt when half of them are."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.size = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(ids, np.cumsum(self.size)[:-1])
        self.kinds = int(ids.max()) + 1
        self._index(np.arange(len(sets)))

    def _index(self, members: np.ndarray) -> None:
        self.covered = len(members)
        ids = np.concatenate([self.ids[m] for m in members])
        owner = np.repeat(members, self.size[members])
        order = np.argsort(ids, kind="stable")
        self.owner = owner[order]
        self.at = np.searchsorted(ids[order], np.arange(self.kinds + 1))

    def linked(self, x: int, rest: np.ndarray) -> np.ndarray:
        if 2 * len(rest) < self.covered:
            self._index(rest)
        start, n = self.at[self.ids[x]], np.diff(self.at)[self.ids[x]]
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.size))[rest]
        union = self.size[x] + self.size[rest] - common
        return 100 * common >= self.percent * union


def confirmed_links(docs: DataFrame, groups: DataFrame, text: str, scratch: Scratch,
                    percent: int) -> DataFrame:
    """a, b of linked members of the candidate groups, by their full sets.
    ``groups``: id and group of every class that is in one; ``docs``: doc_id, text."""
    packed = zipped(docs.where("doc_id is not null"), text, ("doc_id",))
    # The groups grow with the documents: never broadcast, also where they are few.
    rows = packed.join(groups.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(unzipped(whole), "__text"):
                hashes, first = shingle_sets(*text_bytes(b.column("__text")))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("group"),
                     pa.array(np.diff(first), pa.int64()),
                     pa.array([hashes[s:e].tobytes() for s, e in zip(first[:-1], first[1:])],
                              pa.binary())], names=["id", "group", "n", "set"])

    full = scratch.write(rows.mapInArrow(sets, "id long, group long, n long, set binary"), "sets")
    large = (full.groupBy("group").agg(F.sum("n").alias("n"))
             .where(F.col("n") > GROUP_SHINGLES)
             .select("group", F.ceil(F.col("n") / GROUP_SHINGLES).alias("blocks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in sorted_groups(batches, ["group", "i", "j"]):
            ids, blobs = table.column("id").to_numpy(), table.column("set")
            a, b = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                members = [np.frombuffer(x, np.uint64) for x in blobs.slice(s, e - s).to_pylist()]
                label = merge_members(e - s, CommonShingles(members, percent).linked)
                merged = np.flatnonzero(label != np.arange(e - s))
                a.append(ids[s:e][merged])
                b.append(ids[s:e][label[merged]])
            yield _edge_batch(np.concatenate(a), np.concatenate(b))

    return (in_blocks(full, "group", large).select("group", "i", "j", "id", "set")
            .repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "id")
            .mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """``keep`` columns (doc_id among them), n_shingles, component_id and kept; links from
    ``percent`` % similarity on. The result is written; nothing else stays in the shared
    folder."""
    matches = matches_for(percent)
    keep = tuple(c for c in keep if c not in ("n_shingles", "component_id", "kept"))
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.write(with_signatures(docs, keep, text), "signatures")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(
        named.groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    posted = scratch.write(postings(classes, matches), "postings")
    groups = components(list_edges(posted, classes, matches), scratch, "groups")
    roots = groups.select(F.col("root").alias("node"), "root").distinct()
    groups = groups.unionByName(roots).select(F.col("node").alias("id"),
                                              F.col("root").alias("group"))
    links = confirmed_links(docs.select("doc_id", F.col(text).alias("text")), groups, "text",
                            scratch, percent)
    labels = components(links, scratch, "links")
    of_class = (classes.select("d1", "d2", "n_shingles", "id")
                .join(labels.withColumnRenamed("node", "id"), "id", "left")
                .select("d1", "d2", "n_shingles",
                        F.coalesce("root", "id").alias("component_id")))
    found = rows.drop("sig").join(of_class, ["d1", "d2", "n_shingles"], "left")
    # Without words, a set belongs to no class: the document stays by itself.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    result = scratch.write(
        found.withColumn("component_id", component)
        .withColumn("kept", F.col("doc_id").isNull()
                    | (F.col("doc_id") == F.col("component_id")))
        .select(*keep, "n_shingles", "component_id", "kept"), "result")
    scratch.keep_only("result")
    return result
