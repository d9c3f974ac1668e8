"""What op13 does per byte: comparisons, sorted bytes, batches per hash range."""

import random

import numpy as np
import pytest

from periodlens.llm import suffix_array_dedup as X
from periodlens.llm.substring_dedup import unpack_sorted


def laid_out(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    return data, np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(size)), size)


def some_texts(seed):
    pick = random.Random(seed)
    line = bytes(pick.choice(b"abc \xc3\xa9\x00") for _ in range(90))
    return [b"z" * 70, line, line[5:] + line, b"ab" * 60, b"", line[:40] * 4,
            bytes(range(256)), bytes(pick.randrange(256) for _ in range(80)), b"z", b"z"]


@pytest.mark.parametrize("piece, lanes, bits", [(3, 2, 63), (40, 1, 63), (1 << 17, 1024, 0),
                                                (25, 5, 0)])
def test_pieces_and_wide_keys(piece, lanes, bits, monkeypatch):
    for name, value in (("PIECE", piece), ("LANES", lanes), ("KEY_BITS", bits)):
        monkeypatch.setattr(X, name, value)
    for seed in range(5):
        data, end, stretch = laid_out(some_texts(seed))
        raw = data.tobytes()
        suffix = [([b + 1 for b in raw[i:end[i]]] + [0], int(stretch[i]))
                  for i in range(len(raw))]
        want = sorted(range(len(raw)), key=suffix.__getitem__)
        assert X.suffix_array(data, end, stretch).tolist() == want
        got = X.common_prefixes(X.leading_bytes(data, end), end, np.array(want), 60).tolist()
        for k, (a, b) in enumerate(zip(want, want[1:]), 1):
            same = 0
            while (same < min(60, end[a] - a, end[b] - b)) and raw[a + same] == raw[b + same]:
                same += 1
            assert got[k] == same


class Counted(np.ndarray):
    read = 0

    def __getitem__(self, key):
        out = super().__getitem__(key)
        Counted.read += np.size(out)
        return out


def test_prefixes_that_follow_from_a_neighbour_are_not_compared():
    """Each position was compared with its neighbour, two numbers read for each."""
    data, end, stretch = laid_out([b"Thhaen " * 900, b"of the " * 700])
    sa = X.suffix_array(data, end, stretch)
    lead = X.leading_bytes(data, end)
    Counted.read = 0
    got = X.common_prefixes(lead.view(Counted), end, sa, 400)
    assert Counted.read < 1.5 * len(data)
    assert (np.asarray(got) >= 400).sum() == len(data) - 2 * (400 + 6)


def test_runs_whose_bytes_overlap_are_sorted_once():
    assert X._overlapping([[0, 5], [10, 20], [59, 60], [99, 110]], 40) == [
        [[0, 5], [10, 20]], [[59, 60]], [[99, 110]]]
    pick = random.Random(5)
    raw = bytes(pick.choice(b"abcd") for _ in range(120))
    shard = X.Shard()
    shard.add(7, 10, raw[10:60 + 39], [[10, 20], [50, 60]])
    assert shard.size == 89
    at, number = shard.classes(40)
    row, at = shard.places(at)
    assert sorted(at) == [*range(10, 20), *range(50, 60)] and set(row) == {7}
    assert len(set(number)) == 20


def test_many_hash_ranges_share_a_batch():
    """Ranges and shards both grow with the input: a batch each is their product."""
    pick = random.Random(6)
    raw = bytes(pick.choice(b"abcdefgh") for _ in range(20_000))
    shard = X.Shard()
    shard.add(3, 0, raw, [[0, 20_000 - 39]])
    batches = list(X.shard_rows(shard, 40, 1000, 4))
    assert len(batches) == 1
    rows = batches[0].to_pylist()
    assert [r["part"] for r in rows] == list(range(1000))
    assert sum(len(unpack_sorted(r["hashes"])) for r in rows) == 20_000 - 39
