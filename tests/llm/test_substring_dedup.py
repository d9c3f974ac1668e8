import random
import re
import time

import numpy as np
import pytest

from periodlens.llm import substring_dedup as S

from .conftest import hostile_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width):
    """(n_words, kept words) per row; equal doc_ids are one document, null comes last."""
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [(d is None, d or 0) for d, _ in rows]
    first = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in zip(ids, words):
        gone = {i + k for i in range(len(w) - width + 1) if first[tuple(w[i:i + width])] < (d, i)
                for k in range(width)}
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def check(rows, docs, width, **options):
    found = {}
    for r in S.substring_dedup(docs, width, **options).collect():
        found.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    want = {}
    for (d, t), x in zip(rows, brute(rows, width)):
        want.setdefault((d, None if t is None else len(t)), []).append((t, x))
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    for key, items in want.items():
        got = sorted((r["n_words"], r["n_removed"], WORD.findall(r["text"] or ""))
                     for r in found[key])
        assert got == sorted((n, n - len(kept), kept) for _, (n, kept) in items)
        for t, (n, kept) in items:
            if n == len(kept):  # untouched texts stay as they are, null too
                assert any(r["text"] == t for r in found[key])
            else:
                assert any(r["text"] == " ".join(kept) for r in found[key])


def corpus(seed, n=120):
    rng = random.Random(seed)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randint(3, 14))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else
                 " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 8)))
                 for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([k, k, k, rng.randint(0, n), None]),
                     rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed,group", [(1, 2_000_000), (2, 40), (3, 7)])
def test_brute_force(spark, documents, seed, group):
    """Small groups make prefixes of several words and splits by path."""
    rows = corpus(seed)
    check(rows, documents(rows).repartition(5), 5, group=group)


def test_slices_do_not_matter(spark, documents, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(S, "SLICE", 200)
    check(rows, documents(rows).repartition(2), 4, group=100)


def test_hostile_rows(spark, documents):
    rows = [r[:2] for r in hostile_rows()]
    docs = documents(hostile_rows()).selectExpr("*", "'c' AS n_words", "array(1) AS places")
    check(rows, docs, 20)
    assert S.substring_dedup(docs.limit(0)).count() == 0


def test_a_passage_of_sixty_words_goes_from_all_but_the_first(spark, documents):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"a{k} b{k} {passage} c{k}") for k in range(50)]
    got = {r["doc_id"]: r for r in S.substring_dedup(documents(rows)).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[k]["text"] == f"a{k} b{k} c{k}" and got[k]["n_removed"] == 60
               for k in range(1, 50))


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 100, 5000):
        values = np.sort(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        assert (S.unpack_sorted(S.pack_sorted(values)) == values).all()
        small = rng.integers(0, 10 ** rng.integers(1, 12), n)
        assert (S.unpack_small(S.pack_small(small)) == small).all()
    assert S.pack_sorted(np.array([5] * 3 + [1 << 63], np.uint64))
    odd = np.array([0, 0, (1 << 64) - 1], np.uint64)
    assert (S.unpack_sorted(S.pack_sorted(odd)) == odd).all()


def test_heavy_branches_are_extended_and_the_rest_is_hashed():
    codes = np.array([1, 2, 3, 1, 2, 4, 5, 1, 2, 3], np.int64)
    begin = np.arange(7)
    tree = S.PrefixTree(10)
    assert tree.branches(codes, begin)[0].tolist() == codes[:7].tolist()
    tree.extend(np.array([1, 5]))  # nodes 1 and 2
    tree.extend(np.array([S.CODES + 2]))  # node 3: first words 1, 2
    tree.extend(np.array([3 * S.CODES + 4]), by_path=True)
    branch, by_path = tree.branches(codes, begin)
    assert branch.tolist() == [3 * S.CODES + 3, 2, 3, 3 * S.CODES + 4, 2, 4, 2 * S.CODES + 1]
    assert by_path.tolist() == [False] * 3 + [True] + [False] * 3
    path = np.arange(7).astype(np.uint64)
    group = tree.group_of(codes, begin, path)
    other = tree.group_of(codes, begin, path + np.uint64(100))
    assert (group < 10).all() and (group == other).tolist()[:3] == [True] * 3


def test_many_branches_take_no_time():
    tree = S.PrefixTree(1000)
    rng = np.random.default_rng(2)
    begun = time.perf_counter()
    for _ in range(4):
        tree.extend(np.unique(rng.integers(0, 1 << 40, 25_000)))
    codes = rng.integers(0, S.CODES, 300_000)
    tree.branches(codes, np.arange(299_990))
    assert len(tree.heavy) > 99_000 and time.perf_counter() - begun < 5


def test_groups_fit_however_skewed_the_prefixes(spark, documents):
    """Half of all suffixes begin alike: groups stay within their bound of suffixes."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "the", "of", f"w{rng.randint(0, 99)}"])
                         for _ in range(200))) for k in range(60)]
    docs = documents(rows)
    tree = S.grow_tree(docs, 6, 2000)
    assert tree.groups == -(-3 * 60 * 195 // 2000) and len(tree.heavy) > 3
    size = np.zeros(tree.groups, int)
    for _, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, first = S.word_bounds(raw, np.array([0, len(raw)]))
        words = S.range_hashes(raw, starts, ends)
        path = S.window_hashes(words, 6)
        size += np.bincount(tree.group_of(S.word_codes(words), np.arange(195), path),
                            minlength=tree.groups)
    assert size.sum() == 60 * 195 and size.max() <= 2000
    check(rows, docs, 6, group=2000)
