import random
import re

import numpy as np
import pytest

from periodlens.llm import mixing as M

from .conftest import hostile_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets():
    sizes, weights = {"a": 10, "b": 1000, "c": 1000}, {"a": 5, "b": 2, "c": 1}
    t = M.targets(sizes, weights)
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(2010)
    assert t["b"] == pytest.approx(2 * t["c"])
    assert M.cycled_weights(["b", None, "a", "é", "Z"]) == {"Z": 5, "a": 2, "b": 1, "é": 5, None: 2}
    assert M.targets({}, {}) == {} and M.targets({"x": 0}, {"x": 5})["x"] == 0


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (1, 99):
            got = M.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))
    a = M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64))
    b = M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2, np.uint64))
    assert (a == b).mean() < 0.05 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def test_draws_meet_the_slots():
    counts = M.draw_shards({0: 1000, 1: 3, 2: 0, 3: 477}, 16, 5)
    assert counts.sum(axis=0).tolist() == [1000, 3, 0, 477]
    assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1
    assert (counts[:, 3] > 0).all() and len(set(counts[:, 0])) > 3  # drawn, not divided
    assert M.draw_shards({}, 4, 1).shape == (4, 0)


def make(documents):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{i}" for i in range(rng.randint(0, 400))), "en",
             rng.choices(["big", "mid", "s3", "s4", None], [30, 5, 1, 1, 1])[0])
            for k in range(400)]
    return rows, documents(rows + [(r[0], r[1], "en", "odd") for r in hostile_rows()])


def test_mix(spark, documents):
    rows, docs = make(documents)
    m = M.Mix(docs.selectExpr("*", "7 AS size", "8 AS taken"), keep=("lang", "taken"))
    got = m.documents.collect()
    assert len(got) == docs.count()
    size, taken = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id > 20").collect()}
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]])) for r in got
               if r["doc_id"] in texts)
    want = M.targets(size, M.cycled_weights(list(size)))
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * M.BLOCK_WORDS
        assert {r["target"] for r in got if r["source"] == s} == {t}
        assert {r["source_size"] for r in got if r["source"] == s} == {size[s]}
    # Every slot has its block, and blocks hold the documents' words once.
    slots, blocks = m.slots.collect(), m.blocks.collect()
    assert len({(s["shard"], s["slot"]) for s in slots}) == len(slots)
    held = {}
    for b in blocks:
        held[b["source_id"], b["block"]] = held.get((b["source_id"], b["block"]), 0) + b["words"]
    assert sum(held.values()) == sum(size.values()) and max(held.values()) == M.BLOCK_WORDS
    assert {(s["source_id"], s["block"]) for s in slots} <= set(held)
    assert sum(held[s["source_id"], s["block"]] for s in slots) == sum(taken.values())


def test_reruns_agree_whatever_the_partitions(spark, documents):
    _, docs = make(documents)
    def rows(d):
        return sorted((tuple(r) for r in M.mix_sources(d).collect()),
                      key=lambda r: tuple((x is None, x) for x in r))
    assert rows(docs) == rows(docs.repartition(7)) == rows(docs.orderBy("n_chars").coalesce(1))


def test_empty(spark, documents):
    docs = documents([(1, "a")])
    assert M.mix_sources(docs.limit(0)).count() == 0
    assert [tuple(r) for r in M.mix_sources(documents([(1, None), (2, " ")])).select(
        "size", "taken").collect()] == [(0, 0)] * 2
