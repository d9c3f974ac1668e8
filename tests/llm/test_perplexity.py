"""Word n-gram perplexity: dictionaries over the other texts, bands, scripts, odd rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.llm import perplexity as P
from periodlens.llm.scratch import SHUFFLE_CLEANUP

from .conftest import hostile_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces_of(text):
    found = (tuple(re.findall(r"[^\x20\x09]+", piece)) for piece in
             re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)))
    return [p for p in found if p]


def odd(word):
    return any(c in word for c in P.SYMBOLS.decode())


def pairs_of(pieces):
    return Counter((None if v is None or odd(v) else v, w) for p in pieces
                   for v, w in zip([None, *p], p) if not odd(w))


def by_dictionaries(texts):
    """Mean negative log probability of each text of one language, by pieces it has not."""
    each = [pieces_of(t) for t in texts]
    count = pairs_of({p for pieces in each for p in pieces})
    ends, times = Counter(w for _, w in count), lambda c, n: sum(x == n for x in c.values())
    d = P.discounts(*(times(count, n) for n in (1, 2, 3, 4)))
    e = P.discounts(*(times(ends, n) for n in (1, 2, 3, 4)))
    less = lambda n, d: max(n - d[min(n, 3) - 1], 0) if n else 0
    left = sum(e[min(n, 3) - 1] for n in ends.values()) / max(len(count), 1)
    after, begun = defaultdict(list), Counter()
    for (v, _), n in count.items():
        after[v].append(n)
        begun[v] += n
    out = []
    for pieces in each:
        own, started = pairs_of(set(pieces)), Counter()
        for (v, _), n in own.items():
            started[v] += n
        total = 0.0
        for (v, w), n in pairs_of(pieces).items():
            kinds = ends[w] - sum(count[u, x] == m for (u, x), m in own.items() if x == w)
            p = less(kinds, e) / len(count) + left / len(ends)
            rest = begun[v] - started[v]
            if rest:
                back = sum(d[min(k, 3) - 1] for k in after[v]) / rest
                p = less(count[v, w] - own[v, w], d) / rest + min(back, 1) * p
            total -= n * math.log(min(p, 1))
        size = sum(map(len, pieces))
        total -= sum(odd(w) for p in pieces for w in p) * math.log(left / max(len(ends), 1) or 1)
        out.append(total / size if size else None)
    return out


def sentences(n, seed=5):
    """Prose of 120 words whose first letters follow a few rules."""
    pick, words = random.Random(seed), [f"w{k}" for k in range(60)]
    out = []
    for _ in range(n):
        at, text = 0, []
        for _ in range(pick.randint(1, 120)):
            at = (at * 7 + pick.choice([1, 1, 1, 2, 5, 30])) % 60
            text.append(words[at] + pick.choice(["", "", "", ",", ".", "\n"]))
        out.append(" ".join(text))
    return out


def nlls(spark, docs, **more):
    rows = P.with_nll(docs, ("doc_id", "lang", "n_chars"), "lang", "text", **more).collect()
    return {(r.doc_id, r.lang): r.nll for r in rows}


@pytest.mark.parametrize("part_mass, size", [(1 << 23, 1 << 22), (700, 3000)])
def test_against_dictionaries(spark, documents, monkeypatch, part_mass, size):
    monkeypatch.setattr(P, "SLICE", size)
    texts = sentences(50)
    texts += texts[:3] + [None, "", ".,", "alone", "WORD word Word",
                         "w1 w2 | w3 w4$ w5 ** w6 w7", "| | |, w1 | w1"]
    rows = [(k, t, lang) for lang in ("en", None) for k, t in
            enumerate(texts if lang else texts[20:])]
    got = nlls(spark, documents(rows).repartition(5), part_mass=part_mass)
    for lang in ("en", None):
        want = by_dictionaries(texts if lang else texts[20:])
        for k, x in enumerate(want):
            y = got.pop((k, lang))
            assert (x is None) == (y is None) and (x is None or y == pytest.approx(x, abs=1e-9))
    assert not got


def test_what_the_sums_are_grows_with_the_texts(spark, documents, monkeypatch):
    sizes = []
    for n in (40, 400):
        kept = []
        docs = documents([(k, f"a{k} b{k} c{k}") for k in range(n)])
        scratch_write = P.Scratch.write
        monkeypatch.setattr(P.Scratch, "write", lambda self, df, name, *a: kept.append(
            (name, scratch_write(self, df, name, *a))) or kept[-1][1])
        monkeypatch.setattr(P.Scratch, "drop", lambda self, *names: None)
        P.with_nll(docs, ("doc_id",), "lang", "text")
        counts = dict(kept)["counts"].where("home is null")
        sizes.append(counts.agg(F.sum(F.col("numbers")[4])).first()[0])
        monkeypatch.undo()
    assert sizes == [3 * 40, 3 * 400]


def shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    dirs = [Path(d.getPath()) for d in env.blockManager().diskBlockManager().localDirs()]
    return {p.name for d in dirs for p in d.rglob("shuffle_*.data")}


def test_no_write_leaves_shuffle_files_beside_the_next(spark, documents, monkeypatch):
    docs = documents([(k, t) for k, t in enumerate(sentences(40))]).repartition(4)
    left, write = {}, P.Scratch.write

    def looked_at(self, df, name, *more):
        before = shuffle_files(spark)
        out = write(self, df, name, *more)
        for _ in range(50):  # files go shortly after the write
            left[name] = shuffle_files(spark) - before
            if not left[name]:
                break
            time.sleep(0.1)
        return out

    monkeypatch.setattr(P.Scratch, "write", looked_at)
    setting = spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = P.with_nll(docs, ("doc_id",), "lang", "text")
    assert left == dict.fromkeys(["pieces", "counts", "contexts", "scored"], set())
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting and rows.count() == 40


def cyrillic(seed, n):
    pick = random.Random(seed)
    stems = ["сло", "мир", "дом", "вод", "лес", "гор", "нов", "ста", "бел", "мор", "зем", "тих"]
    tails = ["о", "а", "ы", "ом", "ами", "ный", "ная", "ем", "ит"]
    vocabulary = [a + b for a in stems for b in tails]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [" ".join(pick.choices(vocabulary, weights, k=90)) + "." for _ in range(n)]


def gibberish(seed, n, letters):
    pick = random.Random(seed)
    return [" ".join("".join(pick.choices(letters, k=pick.randint(2, 9))) for _ in range(90))
            for _ in range(n)]


@pytest.mark.parametrize("prose, letters", [
    (cyrillic, "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    (lambda seed, n: [t.translate(str.maketrans("слоамирдвегнтбыэьйзх",
                                                "slwamirdvegntbyoujzh")) for t in
                      cyrillic(seed, n)], "abcdefghijklmnopqrstuvwxyz")])
def test_gibberish_fails_in_any_script(spark, documents, prose, letters):
    good, bad = prose(1, 150), gibberish(2, 50, letters)
    docs = documents([(k, t, "xx") for k, t in enumerate(good + bad)])
    kept = {r.doc_id for r in P.judge_perplexity(docs).where("kept").collect()}
    assert len(kept & set(range(150))) >= 148 and not kept & set(range(150, 200))


def prose(k, words=120):
    rng = np.random.default_rng(k)
    common = "the of and to in is that for it was on are as with his they at be this".split()
    rare = [f"{a}{b}ing" for a in ("st", "pr", "tr", "gl") for b in ("and", "ess", "ound", "eak")]
    return " ".join(rng.choice(common + rare, words)) + "."


def test_bands_reject_odd_texts_and_keep_clean_ones(spark, documents):
    rows = [(k, prose(k), ["en", None][k % 2]) for k in range(120)]
    junk = [(900, " ".join("%$# xq!!zz" for _ in range(60)), "en"),
            (901, " ".join(f"qzx{i}wvk" for i in range(90)), None)]
    docs = documents(rows + junk + [(1000 + i, r[1], "en") for i, r in
                                    enumerate(hostile_rows()) if i in (0, 1, 2, 3)])
    got = {r["doc_id"]: r for r in P.judge_perplexity(
        docs.selectExpr("*", "1 AS kept", "2 AS nll")).collect()}
    assert len(got) == 126
    assert sum(got[k]["kept"] for k, *_ in rows) >= 118
    assert not got[900]["kept"] and not got[901]["kept"] and not got[901]["base_failed"]
    for k in range(1000, 1004):
        assert got[k]["base_failed"] and not got[k]["kept"]
    assert got[1000]["perplexity"] is None and got[1000]["n_words"] == 0


def test_base_columns_and_odd_rows(spark, documents):
    rows = hostile_rows()
    out = P.judge_perplexity(documents(rows), ("doc_id", "source"))
    assert out.columns == ["doc_id", "source", *P.BASE_COUNTS, "base_failed", "perplexity", "low",
                           "high", "kept"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (r.kept and failed)
        assert r.n_words or r.perplexity is None


def test_empty_table(spark, documents):
    assert P.judge_perplexity(documents([(1, "a")]).limit(0)).collect() == []
    one = P.judge_perplexity(documents([(1, None), (2, "")])).collect()
    assert [r.kept for r in one] == [False, False]


def test_discounts_and_columns():
    assert P.discounts(0, 0, 0, 0) == [0.5, 1.0, 1.5]
    y = 10 / (10 + 2 * 5)
    assert P.discounts(10, 5, 2, 1) == pytest.approx([1 - 2 * y * .5, 2 - 3 * y * .4, 3 - 4 * y * .5])
    cols = [np.array([0, 5, 1 << 40]), np.array([], np.int64), np.array([7])]
    assert [c.tolist() for c in P.unpack_columns(P.pack_columns(cols))] == [c.tolist() for c in cols]


def test_texts_are_not_shuffled(spark, documents):
    """Slices meet the answers where they were written: no exchange above their scan."""
    scratch = P.Scratch(spark, "test")
    docs = documents([(k, t) for k, t in enumerate(sentences(30))])
    table = scratch.write_at_home(P.word_slices(docs, ("doc_id",), "lang", "text"), "slices", 4)
    pieces = scratch.write(P.merged(P.piece_sums(table, 30, 2), 2, P.PIECES, P.pair_numbers),
                           "pieces")
    plan = P.gram_sums(table, pieces.where("home is not null"), 30, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
    name = scratch.tables["slices"]
    assert spark.catalog.tableExists(name)
    scratch.drop("slices")
    assert not spark.catalog.tableExists(name)
