import numpy as np
import pytest

from periodlens.llm import language_id as L
from periodlens.llm import queries as Q
from periodlens.llm.scratch import Scratch

from ..conftest import SF_SMALL
from .conftest import hostile_rows

PIECES = sorted([L.WORD, L.WORD + "a", "a", "b", "ab", "ba", "abb", L.WORD + "ab"])


def segmentations(text):
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        if text[:k] in PIECES:
            for rest in segmentations(text[k:]):
                yield (text[:k], *rest)
        elif k == 1:
            for rest in segmentations(text[1:]):
                yield ("?", *rest)


def lattice(words):
    finder, out = L.Pieces(PIECES), {}
    for some, ids in finder.lattice(words):
        out.update((words[w], ids[:, [k]]) for k, w in enumerate(some))
    return out


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(3)
    p = rng.random((len(PIECES) + 1, 2)) * 0.3
    index = {x: k for k, x in enumerate(PIECES)} | {"?": len(PIECES)}
    words = ["a", "ab", "abba", "xabbab", "bbbbaaab", "abab"]
    for word, ids in lattice(words).items():
        want = sum(np.prod([p[index[x]] for x in s], axis=0)
                   for s in segmentations(L.WORD + word))
        assert L.forward(ids, p)[-1][0] == pytest.approx(want)


def test_expected_counts_are_posteriors():
    rng = np.random.default_rng(4)
    p = rng.random((len(PIECES) + 1, 2)) * 0.3
    index = {x: k for k, x in enumerate(PIECES)} | {"?": len(PIECES)}
    ids = lattice(["abbab"])["abbab"]
    got = np.zeros(p.shape)
    L.expected(ids, p, np.array([1]), np.array([3.0]), got)
    want, total = np.zeros(p.shape), 0
    for s in segmentations(L.WORD + "abbab"):
        share = np.prod([p[index[x], 1] for x in s])
        total += share
        for x in s:
            want[index[x], 1] += share
    assert got == pytest.approx(3 * want / total)


def test_words():
    assert L.words_of("Ab1c_d É-x\n" + "y" * 70) == ["ab", "c", "d", "é", "x", "y" * 70]


def test_the_whole_vocabulary_of_letters():
    pieces = L.load_pieces()
    assert len(pieces) == 23_947 and max(map(len, pieces)) == 16
    finder = L.Pieces(pieces)
    for piece in [x for x in pieces if len(x) > 8][::97]:
        word = piece.removeprefix(L.WORD)
        (_, ids), = finder.lattice([word])
        at = ids[len(piece) - 1, 0, len(word)]
        assert (pieces[at] if at >= 0 else None) == (
            L.WORD + word if L.WORD + word in pieces else None) or not piece.startswith(L.WORD)


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 4096])
def test_state_is_carried_over_the_cuts_of_a_long_word(chunk, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    p = rng.random((len(PIECES) + 1, 2)) * 0.3
    index = {x: k for k, x in enumerate(PIECES)} | {"?": len(PIECES)}
    finder = L.Pieces(PIECES)
    for word in ("abbabbaxab", "b", "bbbbbbbbb", "abaabbabbab"):
        want, posterior = 0, np.zeros(len(p))
        for s in segmentations(L.WORD + word):
            share = np.prod([p[index[x]] for x in s], axis=0)
            want = want + share
            for x in s:
                posterior[index[x]] += share[1]
        assert L.long_word(finder, word, p) == pytest.approx(np.log(want))
        got = np.zeros(len(p))
        L.expected_in_long(finder, word, p[:, 1], 2.0, got)
        assert got == pytest.approx(2 * posterior / want[1])


def test_long_words_count_by_their_letters(spark, documents, monkeypatch):
    """Neither fitting nor scoring depends on which words go alone."""
    docs = train(documents)
    want = sorted(map(tuple, L.identify(docs, docs.lang.isNotNull()).collect()))
    monkeypatch.setattr(L, "LONGEST", 3)
    monkeypatch.setattr(L, "EVIDENCE", 10**6)
    alone = sorted(map(tuple, L.identify(docs, docs.lang.isNotNull()).collect()))
    assert [r[:2] for r in alone] == [r[:2] for r in want]
    long = documents([(1, "x" * 70_000, "en"), (2, "dieseranderenaufgehendensonne" * 400, None),
                      (3, "thehouseoftherisingsun" * 400, None)])
    got = L.predict(long, L.fit(docs, L.load_pieces(), Scratch(spark, "t"))).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] > 1} == {2: "de", 3: "en"}


def train(documents):
    en = ["the house of the rising sun", "this is the way we wash the hands", "with the other one"]
    de = ["das haus der aufgehenden sonne", "das ist der weg", "mit dem anderen und der einen"]
    return documents([(k, en[k % 3], "en") for k in range(9)]
                     + [(k, de[k % 3], "de") for k in range(9, 18)]
                     + [(18, "rows without a language do not learn", None), (19, None, "fr")])


def test_fit_predict_edges(spark, documents):
    docs = train(documents)
    models = L.fit(docs, L.load_pieces(), Scratch(spark, "t"))
    assert [m.languages for m in models] == [["de", "en"]]
    extra = documents([(r[0], r[1], "xx") for r in hostile_rows()] + [(90, "the other sun"),
                      (91, "der andere Weg")]).selectExpr("*", "'q' AS lang_pred", "1 AS score")
    got = L.predict(extra, models, ("doc_id", "text", "lang_pred", "score")).collect()
    assert len(got) == len(hostile_rows()) + 2
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1 and (letters or r["score"] == 0)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert (by_id[90], by_id[91]) == ("en", "de")


def test_language_groups(spark, documents, monkeypatch):
    docs = train(documents)
    want = sorted(map(tuple, L.identify(docs, docs.lang.isNotNull()).collect()))
    monkeypatch.setattr(L, "LANGUAGES_AT_ONCE", 1)
    got = sorted(map(tuple, L.identify(docs, docs.lang.isNotNull()).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_nothing_to_learn(spark, documents):
    docs = documents([(1, "some text", None), (2, None, None)])
    assert {tuple(r) for r in L.identify(docs, docs.lang.isNotNull()).collect()} == {
        (1, "und", 0.0), (2, "und", 0.0)}
    assert L.identify(docs.limit(0), docs.lang.isNotNull()).count() == 0


def test_query_on_held_out_rows(spark):
    got = Q.QUERIES["op3_language_id"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert got.count() == docs.count()
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_decision_and_score_against_enumeration(spark, documents):
    """Texts over a small vocabulary: every word's segmentations written out."""
    rng = np.random.default_rng(8)
    p = rng.random((len(PIECES) + 1, 3)) * 0.2
    index = {x: k for k, x in enumerate(PIECES)} | {"?": len(PIECES)}
    letters, shares = np.array([97, 98], np.uint32), np.log([0.25, 0.75])
    model = L.Model(PIECES, ["x", "y", "z"], p, letters, shares, -9.0)
    model.least, model.noise = np.array([0.1, 0.2, 0.3]), np.array([1, 2, 3])
    texts = [" ".join("".join(rng.choice(list("abq"), rng.integers(1, 6)))
                      for _ in range(rng.integers(1, 30))) for _ in range(25)]
    rows = L.predict(documents(list(enumerate(texts))), [model], fits=True).collect()
    for r in rows:
        words = texts[r["doc_id"]].split()
        logs = sum(np.log(sum(np.prod([p[index[x]] for x in s], axis=0)
                              for s in segmentations(L.WORD + w))) for w in words)
        mean = logs / len(words) * min(len(words), L.EVIDENCE)
        top = int(mean.argmax())
        assert r["lang_pred"] == "xyz"[top]
        assert r["score"] == pytest.approx(np.exp(mean[top]) / np.exp(mean).sum())
        alone = sum({"a": shares[0], "b": shares[1]}.get(c, -9.0)
                    for w in words for c in w)
        size = sum(map(len, words))
        assert r["fit"] == pytest.approx((logs[top] - alone) / size)
        assert r["floor"] == pytest.approx([0.1, 0.2, 0.3][top] - [1, 2, 3][top] / size ** 0.5)


def test_floors_follow_the_learned_words(spark, documents):
    docs = train(documents)
    scratch = Scratch(spark, "t")
    model, = L.fit(docs, L.load_pieces(), scratch, fits=True)
    words = L.count_words(docs.where("lang is not null"), "lang", "text").collect()
    logs = L.word_logs(L.Pieces(model.pieces), [r["word"] for r in words], model.p)
    gain = logs - model.background([r["word"] for r in words])[:, None]
    for k, language in enumerate(model.languages):
        mine = [(g[k], len(r["word"]), r["n"]) for g, r in zip(gain, words)
                if r["lang"] == language]
        g, size, n = np.array(mine).T
        mean = (n * g).sum() / (n * size).sum()
        assert model.least[k] == pytest.approx(L.SHARE * mean)
        var = (n * (g - mean * size) ** 2).sum() / n.sum()
        letters = (n * size).sum() / n.sum()
        assert model.noise[k] == pytest.approx(L.NOISE * np.sqrt(var / letters))
