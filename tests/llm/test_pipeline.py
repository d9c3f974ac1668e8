import inspect
import random
import re

import corpus_pipeline as C
import pytest

from periodlens.llm import mixing

from ..conftest import SF_SMALL
from .conftest import hostile_rows
from .test_minhash_join import brute as near_brute
from .test_substring_dedup import brute as substring_brute

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in C.STAGES:
        docs = at[name] = stage(spark, docs, SF_SMALL).cache()
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    start = rows_of(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    first = rows_of(at["language_id"])
    lettered = {k for k, r in start.items() if any(c.isalpha() for c in r["text"])}
    assert set(first) <= lettered and len(first) >= 0.98 * len(lettered)
    root = near_brute([(k, r["text"]) for k, r in first.items()], C.NEAR_PERCENT)
    second = rows_of(at["near_dedup"])
    assert set(second) == set(root.values())
    assert all(second[k] == first[k] for k in second)
    third = rows_of(at["substring_dedup"])
    pairs = [(k, r["text"]) for k, r in second.items()]
    for (k, text), (n, kept) in zip(pairs, substring_brute(pairs, 20)):
        assert third[k]["text"] == (text if len(kept) == n else " ".join(kept))
        assert third[k]["n_chars"] == len(third[k]["text"])
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    fourth = rows_of(at["decontamination"])
    leaking = {k for k, r in third.items() if any(t in r["text"] for t in items)}
    assert not leaking & set(fourth) and set(fourth) <= set(third)
    assert len(fourth) >= 0.97 * (len(third) - len(leaking))
    mixed = at["mixing"].collect()
    assert {r["doc_id"] for r in mixed} == set(fourth)
    assert all(r["size"] == len(WORD.findall(fourth[r["doc_id"]]["text"])) for r in mixed)
    assert all(r["taken"] <= 3 * r["size"] for r in mixed)
    sizes, taken = {}, {}
    for r in mixed:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = mixing.targets(sizes, mixing.cycled_weights(list(sizes)))
    assert all(abs(taken[s] - t) <= 2 * mixing.BLOCK_WORDS for s, t in want.items())


@pytest.mark.parametrize("rows", [hostile_rows(), []])
def test_hostile_rows_pass_every_stage(spark, documents, rows):
    base = documents(hostile_rows())
    docs = base if rows else base.limit(0)
    for name, stage in C.STAGES:
        alone = stage(spark, docs, SF_SMALL)
        assert alone.count() <= len(rows), name
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == base.columns
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(left) == len(set(left))


def test_contract():
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "substring_dedup",
                                        "decontamination", "mixing"]
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in C.STAGES)


WORDS = {"en": "the house of rising sun this is way we wash our hands with other one and then "
               "people said that they would have been here before winter came again".split(),
         "de": "das haus der aufgehenden sonne dies ist ein weg auf dem wir unsere haende "
               "waschen und dann sagten die leute dass sie vor dem winter hier waren".split()}


def prose(lang, seed, words=40):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS[lang]) for _ in range(words))


def test_texts_in_no_learned_language_go(spark, documents):
    """With one learned language every text gets it, with score 1: its fit tells."""
    clean = [(k, prose("en", k, 20 + k % 60), "en") for k in range(300)]
    strange = [(1000 + k, prose("de", k), None) for k in range(20)]
    pick = random.Random(5)
    junk = [(2000 + k, " ".join("".join(pick.choices("qwxzvkjy", k=pick.randint(2, 7)))
                                for _ in range(40)), None) for k in range(20)]
    got = {r["doc_id"] for r in
           C.identify_language(spark, documents(clean + strange + junk), SF_SMALL).collect()}
    assert len(got & set(range(300))) >= 297 and max(got) < 1000


def test_near_dedup_knows_rows_by_id_and_text(spark, documents):
    clean = [prose("en", k, 60) for k in range(4)]
    rows = [(1, clean[0]), (1, clean[1]), (2, clean[2]), (2, clean[2]), (3, clean[1]),
            (None, clean[3]), (None, clean[3]), (None, clean[0]), (4, "short")]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in
                 C.near_dedup(spark, documents(rows), SF_SMALL).collect())
    assert got == sorted([(1, clean[0]), (1, clean[1]), (2, clean[2]), (-1, clean[3]),
                          (4, "short")])


def test_corpus_is_the_mix_that_run_counts(spark, monkeypatch):
    """The mixed corpus: its slots' words are what run() says it takes, by source."""
    docs = C.cleaned(spark, SF_SMALL)
    monkeypatch.setattr(C, "cleaned", lambda *_: docs)
    slots = C.corpus(spark, SF_SMALL).collect()
    assert {"shard", "slot", "source_id", "block", "text", "parts"} <= set(slots[0].asDict())
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    words, parts = {}, {}
    for r in slots:
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert sum(p["words"] for p in r["parts"]) == len(WORD.findall(r["text"]))
        for p in r["parts"]:
            parts[p["doc_id"]] = parts.get(p["doc_id"], 0) + p["words"]
    taken = C.run(spark, SF_SMALL).collect()
    assert len(taken) > 100 and len(taken) == docs.count()
    by_source = {}
    for r in taken:
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["taken"]
        assert parts.get(r["doc_id"], 0) == r["taken"]
    assert words == {s: n for s, n in by_source.items() if n}


def test_clashing_columns_keep_their_values(spark, documents):
    rows = [(k, prose("en", k)) for k in range(30)]
    docs = documents(rows).selectExpr("*", "doc_id + 5 AS fit", "'mine' AS lang_pred",
                                      "2 AS score", "'x' AS __zip0")
    got = C.identify_language(spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    assert all(r.fit == r.doc_id + 5 and r.lang_pred == "mine" for r in got.collect())
