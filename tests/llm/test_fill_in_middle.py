"""Fill-in-the-middle: contract against plain string code, round trips, odd rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from periodlens.llm import fill_in_middle as X

from .conftest import hostile_rows

MARKS = [(20, "a<P>b" * 9), (21, "<S>"), (22, "<M"), (23, "<P"), (24, "<<S<S<M" * 30),
         (25, "é<é>" * 40), (26, "x"), (27, "🙂<P>"), (28, "ab\x00c<Q>" * 20)]


def by_strings(doc_id, text, seed=1):
    t = text or ""
    n = len(t)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_contract_and_round_trip(spark, documents):
    rows = hostile_rows() + MARKS + [(k, f"text number {k} ä") for k in range(100, 200)]
    docs = documents(rows)
    back = X.restored(X.fill_in_middle(docs, ("doc_id", "text")))
    got = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars,
                             r.output_sha256, r.restored, r.restored_sha256)
                            for r in back.collect())))
    want = []
    for doc_id, text, *_ in rows:
        n, form, prefix, middle, out = by_strings(doc_id, text)
        want.append((doc_id, n, form, prefix, middle, hashlib.sha256(out.encode()).hexdigest(),
                     text or "", hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(map(repr, want))
    assert {eval(r)[2] for r in got} == {"plain", "psm", "spm"}


def test_output_text(spark, documents):
    docs = documents(MARKS + hostile_rows())
    for r in X.fill_in_middle(docs, ("doc_id", "text"), seed=7).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == \
            by_strings(r.doc_id, r.text, 7)


def test_shares_follow_the_percents(spark, documents):
    docs = documents([(k, "some words of a text") for k in range(3000)])
    seen = {r.form: r["count"] for r in X.fill_in_middle(
        docs, plain_percent=25, spm_percent=50, output=False).groupBy("form").count().collect()}
    assert abs(seen["plain"] / 3000 - 0.25) < 0.04
    assert abs(seen["spm"] / 3000 - 0.375) < 0.04


def test_clashing_columns_and_empty_table(spark, documents):
    docs = documents(MARKS).selectExpr("doc_id", "text", "1 AS form", "'o' AS output", "2 AS n",
                                       "'x' AS restored")
    filled = X.fill_in_middle(docs, tuple(docs.columns))
    assert filled.columns == ["doc_id", "text", "restored", *X.RESULT, "output"]
    assert all(r.restored == r.text for r in X.restored(filled).collect())
    assert X.restored(X.fill_in_middle(docs.limit(0))).collect() == []


def test_no_shuffle(spark, documents):
    plan = X.restored(X.fill_in_middle(documents(MARKS)))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSMaé🙂 ", max_size=40), st.data())
def test_any_cut_comes_back(text, data):
    raw = text.encode()
    if any(m in raw for m in X.SENTINELS.values()):
        return
    spots = sorted(len(text[:data.draw(st.integers(0, len(text)))].encode()) for _ in "ab")
    buffers = (memoryview(raw), memoryview(X._SENTINEL_BUFFER))
    for form, order in X.ARRANGED.items():
        out = X.cut(0, len(raw), *spots).permuted(order).rendered(buffers)
        assert X.restored_pieces(out, form).rendered((memoryview(out),) * 2) == raw


def test_sentinels_across_rows_are_none():
    import numpy as np
    data = np.frombuffer(b"a<P>b<S>", np.uint8)
    assert X._with_sentinel(data, np.array([0, 3, 5, 8])).tolist() == [False, False, True]
    assert X._with_sentinel(data[:2], np.array([0, 2])).tolist() == [False]


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_empty_pieces(form):
    out = X.cut(0, 0, 0, 0).permuted(X.ARRANGED[form]).rendered(
        (memoryview(b""), memoryview(X._SENTINEL_BUFFER)))
    assert X.restored_pieces(out, form).rendered((memoryview(out),) * 2) == b""
