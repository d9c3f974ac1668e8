import random

import numpy as np
import pyarrow as pa
import pytest

from periodlens.llm import decontamination as D

from .conftest import hostile_rows


def words(rng, n, kind="w"):
    return [f"{kind}{rng.randint(0, 5000)}x" for _ in range(n)]


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (D.MATCH if x == y else D.MISMATCH),
                                  h[i][j + 1] + D.GAP, h[i + 1][j] + D.GAP)
            best = max(best, h[i + 1][j + 1])
    return best


def test_align_equals_cell_by_cell():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    passages = [rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    score, first, last = D.align(items, passages)
    for a, b, s, f, z in zip(items, passages, score, first, last):
        assert s == smith_waterman(a, b)
        if s:  # the reported stretch alone reaches the score
            assert smith_waterman(a, b[f:z + 1]) == s


@pytest.fixture
def benchmark(spark):
    rng = random.Random(8)
    items = [" ".join(words(rng, n)) for n in [60, 40, 25, 12, 80, 50] * 3]
    rows = [(k, t) for k, t in enumerate(items)] + [(90, items[0]), (91, None), (92, "two words"),
                                                    (None, items[1])]
    return items, spark.createDataFrame(rows, "item_id long, text string")


def edited(rng, item, share):
    out = []
    for w in item.split():
        x = rng.random()
        out += [] if x < share / 3 else [f"new{rng.randint(0, 999)}"] if x < share * 2 / 3 \
            else [w, "put"] if x < share else [w]
    return " ".join(out)


def test_finds_whole_and_edited_copies_and_leaves_clean_texts(spark, documents, benchmark):
    items, table = benchmark
    rng, rows, want = random.Random(9), [], {}
    for k in range(200):
        text = words(rng, rng.randint(0, 300), "t")
        if k % 3 == 0:
            n = rng.randrange(len(items))
            copy = [items[n], items[n].upper().replace(" ", ", "),
                    edited(rng, items[n], rng.choice([0.1, 0.2, 0.3]))][k // 3 % 3]
            at = rng.randint(0, len(text))
            text[at:at] = copy.split()
            want[k] = n
        rows.append((k, " ".join(text)))
    got = {r["doc_id"]: r["leaks"] for r in D.with_leaks(documents(rows), table).collect()}
    assert len(got) == 200
    for k, leaks in got.items():
        found = {x["item_id"] for x in leaks}
        if k in want:
            assert want[k] in found
            assert found <= {want[k], 90, None}
            if k // 3 % 3 < 2:
                assert max(x["score"] for x in leaks) == 1
                whole = next(x for x in leaks if x["item_id"] == want[k])
                assert whole["last_word"] - whole["first_word"] + 1 == len(items[want[k]].split())
        else:
            assert not found


def test_item_blocks_do_not_change_results(spark, documents, benchmark, monkeypatch):
    items, table = benchmark
    docs = documents([(k, f"before {t} after") for k, t in enumerate(items)])
    key = lambda r: (r["doc_id"], sorted((x["item_id"] or -1, x["score"]) for x in r["leaks"]))
    want = sorted(map(key, D.with_leaks(docs, table).collect()))
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 4)
    assert sorted(map(key, D.with_leaks(docs, table).collect())) == want


def test_hot_passage_and_repeated_words(spark, documents, benchmark):
    items, table = benchmark
    rows = [(k, f"{items[2]} {items[2]} tail{k}") for k in range(80)]
    rows += [(200, "again " * 5000 + items[3]), (201, items[3].split()[0] * 3000)]
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]}
           for r in D.with_leaks(documents(rows), table).collect()}
    assert all(got[k] == {2} for k in range(80)) and got[200] == {3} and not got[201]


def test_slices_with_and_without_leaks_in_one_task(spark, documents, benchmark):
    items, table = benchmark
    long = "clean words only " * 140_000  # a slice of its own
    rows = [(1, long), (2, items[2]), (3, long), (4, "clean"), (5, items[3])]
    got = D.with_leaks(documents(rows).coalesce(1), table).collect()
    assert {r["doc_id"] for r in got if r["leaks"]} == {2, 5} and len(got) == 5


def test_hostile_and_empty(spark, documents, benchmark):
    _, table = benchmark
    docs = documents(hostile_rows()).selectExpr("*", "'clash' AS leaks", "1 AS item_id")
    got = D.with_leaks(docs, table)
    assert got.count() == len(hostile_rows()) and got.where("size(leaks) > 0").count() == 0
    assert D.with_leaks(docs.limit(0), table).count() == 0
    assert D.with_leaks(docs, table.limit(0)).where("size(leaks) > 0").count() == 0


def third_replaced(item, k):
    return " ".join(f"other{k}x{n}" if n % 3 == 2 else w for n, w in enumerate(item.split()))


def put_between(item, k):
    return " ".join(f"{w} put{k}x{n}" for n, w in enumerate(item.split()))


def third_left_out(item, _):
    return " ".join(w for n, w in enumerate(item.split()) if n % 3 != 2)


@pytest.mark.parametrize("change", [third_replaced, put_between, third_left_out])
def test_copies_that_keep_no_ngram_are_found(spark, documents, benchmark, change):
    items, table = benchmark
    rng = random.Random(3)
    rows = [(k, " ".join([*words(rng, 20, "t"), change(items[k % 18], k), *words(rng, 20, "t")]))
            for k in range(54)]
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]}
           for r in D.with_leaks(documents(rows), table).collect()}
    assert all(k % 18 in got[k] for k in range(54))


def text_words(text):
    hashes, _ = D.bare_words(pa.array([text]))
    return hashes


def test_against_the_alignment_of_all_pairs(spark, documents, benchmark):
    """Every text against every item, without seeds: recall and precision."""
    items, table = benchmark
    rng, rows = random.Random(12), []
    pool = [w for t in items for w in t.split()]
    for k in range(220):
        body = words(rng, rng.randint(0, 60), "t") + rng.sample(pool, 5)
        copy = edited(rng, rng.choice(items), rng.choice([0.3, 0.45, 0.6])).split()
        rng.shuffle(body)
        rows.append((k, " ".join(body + copy if k % 4 else body)))
    got = {(r["doc_id"], x["item_id"]) for r in D.with_leaks(documents(rows), table).collect()
           for x in r["leaks"] if x["item_id"] is not None and x["item_id"] < 18}
    item_words = [text_words(t).tolist() for t in items]
    want = {(k, n) for k, t in rows for n, w in enumerate(item_words)
            if smith_waterman(w, text_words(t).tolist()) >= D.THRESHOLD * D.MATCH * len(w)}
    assert got <= want and len(want) > 60
    assert len(got) >= 0.97 * len(want)


def test_short_items_and_scripts_without_spaces(spark, documents):
    table = spark.createDataFrame([
        (1, "Photosynthesis"), (2, "Paris, France"), (3, "\u5149\u5408\u4f5c\u7528\u662f\u690d\u7269\u7684\u8fc7\u7a0b"),
        (4, "\u6c34"), (5, "\u0e01\u0e32\u0e23\u0e2a\u0e31\u0e07\u0e40\u0e04\u0e23\u0e32\u0e30\u0e2b\u0e4c"), (6, "")],
        "item_id long, text string")
    rows = [(10, "photosynthesis"), (11, "The answer: Photosynthesis.\nNext"),
            (12, "about photosynthesis in plants"), (13, "Paris France"), (14, "in Paris, France, we"),
            (15, "so paris france!"), (20, "x\u3002\u5149\u5408\u4f5c\u7528\u662f\u690d\u7269\u7684\u8fc7\u7a0b\u3002y"),
            (21, "\u5149\u5408\u690d\u7269\u4f5c\u7528\u8fc7"), (22, "\u559d\uff0c\u6c34\uff01"), (23, "\u6c34\u679c"),
            (24, "abc \u0e01\u0e32\u0e23\u0e2a\u0e31\u0e07\u0e40\u0e04\u0e23\u0e32\u0e30\u0e2b\u0e4c xyz"), (30, None)]
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]}
           for r in D.with_leaks(documents(rows), table).collect()}
    assert got == {10: {1}, 11: {1}, 12: set(), 13: {2}, 14: set(), 15: set(), 20: {3}, 21: set(),
                   22: {4}, 23: set(), 24: {5}, 30: set()}


def test_words_of_mixed_scripts():
    column = pa.array(["Ab\u4e2d\u6587cd\u3001\U00020000e", None, "\u2014dash\u2014d\u00e9j\u00e0", "\u4e2d"])
    hashes, first, new = D.bare_words(column, pieces=True)
    alone = [text_words(t)[0] for t in ("ab", "\u4e2d", "\u6587", "cd", "\U00020000", "e", "dash",
                                        "d\u00e9j\u00e0", "\u4e2d")]
    assert hashes.tolist() == alone and first.tolist() == [0, 6, 6, 8, 9]
    assert new.tolist() == [True, False, False, False, True, False, True, True, True]


def test_rows_at_once_do_not_change_results(spark, documents, benchmark, monkeypatch):
    items, table = benchmark
    column = pa.array([f"{t} and {items[0]}" for t in items])
    seeds = D.Seeds([text_words(t) for t in items])
    want = D.slice_leaks(column, seeds, 0.45)
    monkeypatch.setattr(D, "PLACES", 1)
    assert D.slice_leaks(column, seeds, 0.45) == want and len(want) >= 35
