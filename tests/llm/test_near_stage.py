import random

import corpus_pipeline as C

from periodlens.llm import minhash_join as M

from ..conftest import SF_SMALL
from .test_minhash_join import shingles, union_find


def near_groups(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    return union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
                            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])


def copies_about_the_border(seed):
    """Copies with ends of their own: similarities from 0.70 to 0.95."""
    rng, rows = random.Random(seed), []
    for g in range(30):
        base = [f"w{g}-{k}" for k in range(rng.randint(60, 200))]
        for c in range(3):
            drop = int(len(base) * rng.uniform(0.02, 0.15))
            rows.append(" ".join([*base[:len(base) - drop],
                                  *(f"x{g}-{c}-{k}" for k in range(drop))]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_dedup_links_from_80_percent(spark, documents):
    rows = copies_about_the_border(4)
    want = near_groups(rows, 80)
    assert set(want.values()) != set(near_groups(rows, 85).values())  # the border matters
    got = {r["doc_id"] for r in C.near_dedup(spark, documents(rows), SF_SMALL).collect()}
    assert got == set(want.values())


def test_percent_sets_the_matches(spark, documents):
    assert [M.matches_for(p) for p in (80, 85)] == [35, 40]
    rows = copies_about_the_border(6)
    for percent in (75, 85):
        got = {r["doc_id"]: r["component_id"]
               for r in M.near_duplicates(documents(rows), percent=percent).collect()}
        assert got == near_groups(rows, percent)
