import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from periodlens.llm.text_stats import text_counts
from periodlens.llm.words import range_hashes, slices, text_bytes, window_hashes, \
    window_starts, word_bounds

WORD = re.compile("[^\x20\x09-\x0d]+")
texts = st.lists(st.none() | st.text(alphabet="abé\x1c\xa0 \t\n\x0b#!", max_size=30), max_size=8)


@settings(deadline=None, max_examples=150)
@given(texts)
def test_words_and_windows(rows):
    data, at = text_bytes(pa.array(rows, pa.string()))
    starts, ends, first = word_bounds(data, at)
    words = [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(first[:-1], first[1:])] == \
        [WORD.findall(t or "") for t in rows]
    hashes = range_hashes(data, starts, ends)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    begin = window_starts(first, 2)
    want = [i for a, b in zip(first[:-1], first[1:]) for i in range(a, b - 1)]
    assert begin.tolist() == want
    pairs = window_hashes(hashes, 2)
    assert len({(words[i], words[i + 1]) for i in want}) == len({int(pairs[i]) for i in want})


@settings(deadline=None, max_examples=100)
@given(texts)
def test_counts(rows):
    got = text_counts(*text_bytes(pa.array(rows, pa.string())))
    for i, t in enumerate(rows):
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1
                   for j in range(3)}
        want = dict(n_words=len(words), word_chars=sum(map(len, words)),
                    n_symbols=sum(c in "#*$%&|<>" for c in t),
                    n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered),
                    n_distinct_words=len(set(words)), n_lines=len(lines), n_chars_all=len(t))
        assert {k: got[k][i] for k in want} == want


def test_functions_travel_without_cached_tables():
    from pyspark import cloudpickle

    data, at = text_bytes(pa.array(["some words"]))
    range_hashes(data, *word_bounds(data, at)[:2])
    assert len(cloudpickle.dumps(lambda: range_hashes(data, at[:1], at[1:]))) < 50_000


def test_slices_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array([None, "x" * 50, "", "y" * 9, "z"] * 3)], ["text"])
    parts = list(slices(b, limit=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == b.column(0).to_pylist()
    assert all(p.num_rows == 1 or text_bytes(p.column(0))[1][-1] <= 10 for p in parts)
    sliced = b.slice(3, 2)
    assert bytes(text_bytes(sliced.column(0))[0]) == b"yyyyyyyyyz"
    assert np.array_equal(text_bytes(b.slice(0, 0).column(0))[1], [0])
