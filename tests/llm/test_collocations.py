"""Phrase collocations: brute force, the summaries' guarantee, exact scores, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periodlens.llm import collocations as X

from .conftest import hostile_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, longest=5, top=2000, cover=100):
    f, n = Counter(), Counter()
    for _, text, *rest in rows:
        lang = (rest[0] if rest else "en") or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1)
                     for i in range(len(w) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= min_count:
            found[lang, w] = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k)
                                 for k in range(1, len(w)))
    rows = {}
    for (lang, w), (score, k) in found.items():
        a = f[lang, w]
        if not any(x == lang and len(v) > len(w) and 100 * f[x, v] >= cover * a
                   and any(v[i:i + len(w)] == w for i in range(len(v))) for x, v in found):
            rows.setdefault(lang, []).append(
                (-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang], k))
    return sorted((lang, rank, p.decode(), -a, le, r, total, -s, k) for lang, some in rows.items()
                  for rank, (s, a, p, le, r, total, k) in enumerate(sorted(some)[:top], 1))


def made_texts(n, seed=1):
    pick = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "a", "red", "fox", "é", "漢字", "x|y", "Run"]
    fixed = ["new york city", "the red fox of york", "run x|y run x|y run"]
    out = []
    for k in range(n):
        parts = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 9)))
                 if pick.random() < 0.6 else pick.choice(fixed) for _ in range(pick.randint(1, 12))]
        text = "".join(p + pick.choice([". ", ", ", "\n", " ", "\t", "!?", " \x0b"]) for p in parts)
        out.append((k, text, pick.choice(["en", "en", "fr", None])))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("min_count, part_mass, cover", [(5, 1 << 24, 100), (20, 4000, 60)])
def test_against_brute_force(spark, documents, min_count, part_mass, cover, monkeypatch):
    monkeypatch.setattr(X, "SLICE", 4000)
    monkeypatch.setattr(X, "SUM_AT", 300)
    rows = made_texts(300) + hostile_rows()
    docs = documents(rows).repartition(5)
    got = rows_of(X.collocations(docs, min_count=min_count, cover_percent=cover,
                                part_mass=part_mass))
    assert got == brute(rows, min_count, cover=cover) and len(got) > 20


def test_top_is_the_first_of_all(spark, documents):
    docs = documents(made_texts(150, seed=3))
    every = rows_of(X.collocations(docs, 4, top=None))
    assert rows_of(X.collocations(docs, 4, top=7)) == [r for r in every if r[1] <= 7]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=8),
       st.integers(2, 12), st.booleans())
def test_summary_keeps_all_frequent_keys(parts, least, merged):
    true = Counter(x for p in parts for x in p)
    capacity = sum(true.values()) // least + 1
    total = X.MisraGries(capacity, room=10)
    for p in parts:
        keys, counts = np.unique(np.array(p, np.uint64), return_counts=True)
        part = X.MisraGries(capacity, room=10) if merged else total
        part.add(keys, counts)
        if merged:
            total.merge(part)
    total.settle()
    assert total.off < least and len(total.keys) <= capacity
    kept = dict(zip(total.keys.tolist(), total.counts.tolist()))
    maybe = set(total.candidates(least).tolist())
    for key, n in true.items():
        assert n < least or key in maybe
        assert kept.get(key, 0) <= n <= kept.get(key, 0) + total.off


def test_sums_with_keys_and_counts_of_any_size():
    keys = np.array([0, (1 << 60) - 1, 0, 7], np.uint64)
    for counts in ([1, 2, 3, 4], [1 << 40, 2, 3, 4]):
        k, c = X.sum_by_key(keys, np.array(counts))
        assert k.tolist() == [0, 7, (1 << 60) - 1]
        assert c.tolist() == [counts[0] + 3, 4, 2]
    k, c = X.sum_by_key(np.zeros(3, np.uint64), np.ones(3, np.int64))
    assert (k.tolist(), c.tolist()) == ([0], [3])


def test_products_beyond_64_bits(spark, monkeypatch):
    a, n, le, r = 987654321012, 10 ** 15 + 7, 10 ** 12 + 39, 10 ** 12 + 61
    frequent = spark.createDataFrame(
        [("en", "x y", a), ("en", "x", le), ("en", "y", r)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    monkeypatch.setattr(X, "frequent_phrases", lambda *_: (frequent, totals))
    row = X.collocations(frequent.withColumnRenamed("phrase", "text")).first()
    assert row.score == 1000 * a * n // (le * r)


def test_empty_and_extra_columns(spark, documents):
    docs = documents(made_texts(60)).withColumn("f", F.lit(1)).withColumn("phrase", F.lit("x"))
    assert rows_of(X.collocations(docs, 5)) == brute(made_texts(60), 5)
    assert X.collocations(docs.limit(0), 5).collect() == []
    assert X.collocations(documents([(1, None), (2, "")]), 1).collect() == []
