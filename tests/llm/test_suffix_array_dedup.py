"""Suffix-array dedup: brute force over rows and widths, and each part by itself."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periodlens.llm import suffix_array_dedup as X

from .conftest import hostile_rows


def brute(rows, width):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = {}
    for _, raw in raws:
        for i in range(len(raw) - width + 1):
            w = raw[i:i + width]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for doc_id, raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - width + 1):
            if seen[raw[i:i + width]] > 1:
                gone[i + 1:i + 1 + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        gone = gone[1:-1]
        out.append((doc_id, bytes(b for b, g in zip(raw, gone) if not g), len(raw),
                    int(gone.sum()), spans))
    return sorted(map(repr, out))


def found(docs, width, **sizes):
    rows = X.suffix_array_dedup(docs, width, **sizes).select("doc_id", *X.RESULT).collect()
    return sorted(repr((r.doc_id, bytes(r.kept), *r[2:])) for r in rows)


def made_rows(n, seed=3):
    pick = random.Random(seed)
    bits = ["ab", "ba", "é", "\x00", "x", "the ", "漢", "aaaa"]
    passages = ["".join(pick.choice(bits) for _ in range(k)) for k in (20, 30, 60, 200)]
    rows = []
    for k in range(n):
        text = "".join(pick.choice(passages) if pick.random() < 0.15 else
                       "".join(pick.choice(bits) for _ in range(pick.randint(0, 12)))
                       for _ in range(pick.randint(0, 12)))
        rows.append((k, text))
    return rows + rows[:5] + [(n + 1, rows[3][1] + "tail"), (n + 2, None), (n + 3, "z" * 500),
                              (n + 4, "abc" * 90), (None, rows[7][1]), (None, None)]


@pytest.mark.parametrize("width, shard", [(20, 1 << 20), (24, 300), (60, 1)])
def test_against_brute_force(spark, documents, width, shard, monkeypatch):
    monkeypatch.setattr(X, "SHARD", shard)
    monkeypatch.setattr(X, "LANES", 7)
    rows = made_rows(120)
    got = found(documents(rows).repartition(6), width, target_bytes=4000, range_windows=500)
    assert got == brute(rows, width)


def test_hostile_rows_at_the_contract_width(spark, documents):
    rows = hostile_rows() + [(40, "p" * 399), (41, "q" * 399), (42, "q" * 400), (43, "q" * 400)]
    rows = [(i, t) for i, t, *_ in rows if t is None or len(t) < 30_000]
    assert found(documents(rows), 400) == brute(rows, 400)


def test_hot_passage(spark, documents):
    """A passage that all documents hold, in edges that differ."""
    pick = random.Random(9)
    passage = "".join(pick.choice("abcdefg ") for _ in range(90))
    rows = [(k, f"{pick.random()}" + passage + f"{pick.random()}{k % 3}" * 2) for k in range(150)]
    assert found(documents(rows).repartition(5), 40, target_bytes=900,
                 range_windows=200) == brute(rows, 40)


def test_clashing_columns_and_empty_tables(spark, documents):
    rows = made_rows(30)
    docs = (documents(rows).withColumnRenamed("lang", "row").withColumnRenamed("source", "at")
            .withColumn("n", F.lit(5)).withColumn("kept", F.lit("k")).withColumn("part", F.lit(1)))
    out = X.suffix_array_dedup(docs, 20)
    assert out.columns == ["doc_id", "row", "at", "n_chars", "n", "part", *X.RESULT]
    assert {(r.row, r.at, r.n, r.part) for r in out.collect()} == {("en", "s", 5, 1)}
    assert found(docs, 20) == brute(rows, 20)
    assert found(docs.limit(0), 20) == []
    assert found(documents([(1, None), (2, "")]), 20) == brute([(1, None), (2, "")], 20)


TEXTS = st.lists(st.binary(max_size=40) | st.text("ab\x00", max_size=60).map(str.encode),
                 min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_suffix_array_and_common_prefixes(texts, lanes):
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    stretch = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)[stretch]
    raw = data.tobytes()
    suffix = [([b + 1 for b in raw[i:end[i]]], int(stretch[i])) for i in range(len(raw))]
    want = sorted(range(len(raw)), key=lambda i: (suffix[i][0] + [0], suffix[i][1]))
    sa = X.suffix_array(data, end, stretch)
    assert sa.tolist() == want
    if not len(sa):
        return
    old, X.LANES = X.LANES, lanes
    try:
        got = X.common_prefixes(X.leading_bytes(data, end), end, sa, 25).tolist()
    finally:
        X.LANES = old
    def shared(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return min(k, 25)
    assert got == [0] + [shared(suffix[a][0], suffix[b][0]) for a, b in zip(want, want[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=50), min_size=1, max_size=6))
def test_runs_hold_every_window_once(texts):
    width, gram = 8, 3
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    found = X.runs_of(data, at, width, gram)
    rows = list(zip(*(found[k].tolist() for k in ("row", "at", "n", "key", "run", "self"))))
    windows = [(r, a + i) for r, a, n, *_ in rows for i in range(n)]
    assert windows == [(r, i) for r, raw in enumerate(raws) for i in range(len(raw) - width + 1)]
    where = {}
    for k, (r, a, n, key, run, twice) in enumerate(rows):
        for i in range(a, a + n):
            where.setdefault(raws[r][i:i + width], set()).add((key, k))
    for places in where.values():  # equal windows: one key; twice in a run: known of it
        assert len({key for key, _ in places}) == 1
    for r, a, n, key, run, twice in rows:
        inside = [raws[r][i:i + width] for i in range(a, a + n)]
        assert twice or len(set(inside)) == n


def test_runs_merge_by_binary_search():
    pick = np.random.default_rng(4)
    runs = [np.unique(pick.integers(0, 60, k).astype(np.uint64)) for k in (0, 5, 30, 1, 12, 0, 9)]
    every = np.concatenate(runs)
    value, times = np.unique(every, return_counts=True)
    assert X.merged_runs(runs).tolist() == value[times > 1].tolist()
    assert X.merged_runs([]).tolist() == X.merged_runs(runs[:1]).tolist() == []


def test_places_pack():
    row = np.array([-(1 << 62), 5, 5, 1 << 61, -3], np.int64)
    at = np.array([7, 0, 1 << 33, 2, 2])
    got = set()
    for target, blob in X.pack_places(row, at, 3):
        r, a = X.unpack_places(blob)
        assert set(X.target_of(r, 3).tolist()) == {target}
        got |= set(zip(r.tolist(), a.tolist()))
    assert got == set(zip(row.tolist(), at.tolist()))
    assert X.pack_places(row[:0], at[:0], 3) == []
