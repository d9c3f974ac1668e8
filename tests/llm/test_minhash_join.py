import random

import numpy as np
import pytest

from periodlens.llm import minhash_join as M
from periodlens.llm.components import components
from periodlens.llm.scratch import Scratch

from .conftest import hostile_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, percent=85):
    """Smallest doc_id reachable; all rows of a doc_id are one document."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if any(x and y and 100 * len(x & y) >= percent * len(x | y)
                    for x in sets[a] for y in sets[b])]
    return union_find(ids, edges)


def check(rows, docs):
    root = brute(rows)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                  for r in M.near_duplicates(docs).collect()),
                 key=lambda r: tuple((x is None, x) for x in r))
    want = sorted(((d, len(shingles(t)), root.get(d), d is None or root[d] == d)
                   for d, t in rows), key=lambda r: tuple((x is None, x) for x in r))
    assert got == want


def corpus(seed, groups=12, most=25):
    """Groups of copies, edited a little (links) or more (near the border)."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 250))]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 9999)}"
            rows.append((" " if rng.random() < 0.5 else "\n").join(
                w.upper() if rng.random() < 0.02 else w for w in text))
    rng.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, documents, seed):
    rows = corpus(seed)
    check(rows, documents(rows))


def test_lists_and_groups_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "LIST", 6)
    monkeypatch.setattr(M, "GROUP_SHINGLES", 700)
    rows = corpus(5, groups=6, most=40)
    check(rows, documents(rows).repartition(4))


def test_chain_reaches_its_smallest_document(spark, documents):
    words = [f"w{k}" for k in range(140)]
    texts = []
    for step in range(12):  # each step changes the end of the text before it
        texts.append(" ".join(words))
        words = [*words[:-1][4:], *(f"s{step}-{k}" for k in range(5))]
    rows = [(100 - k, t) for k, t in enumerate(texts)]
    assert len(set(brute(rows).values())) < 12
    check(rows, documents(rows))


def test_hostile_rows(spark, documents):
    rows = [r[:2] for r in hostile_rows()] + [(50, "A b"), (51, "a B"), (52, "a b c")]
    check(rows, documents(rows).selectExpr("*", "0 AS kept", "'q' AS component_id"))
    assert M.near_duplicates(documents(rows).limit(0)).count() == 0


def test_merge_members_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        m = rng.random((n, n)) < 0.05
        m |= m.T
        label = M.merge_members(n, lambda x, rest: m[x, rest])
        want = union_find(range(n), zip(*np.nonzero(m)))
        assert [label[k] for k in range(n)] == [want[k] for k in range(n)]


def test_common_shingles_counts(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 200, replace=False)
    sets = [np.sort(np.unique(np.r_[rng.choice(base, rng.integers(150, 200), replace=False),
                                    rng.integers(0, 10_000, 9)])).astype(np.uint64)
            for _ in range(40)]
    label = M.merge_members(40, M.CommonShingles(sets).linked)
    edges = [(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(
        sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    want = union_find(range(40), edges)
    assert label.tolist() == [want[k] for k in range(40)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(-50, 400), rng.randint(-50, 400)) for _ in range(rng.choice([3, 200,
                                                                                      330]))]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7), (None, 3), (7, 8), (8, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in
           components(df, Scratch(spark, "t"), "t").collect()}
    real = [e for e in edges if None not in e]
    want = union_find({x for e in real for x in e}, real)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(df.limit(0), Scratch(spark, "t"), "t").count() == 0
