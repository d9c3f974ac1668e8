import random
from pathlib import Path

from periodlens.llm import token_counts as T

from .conftest import hostile_rows


def brute(texts):
    e = T.load_encoding(Path(T.VOCABULARY).read_bytes())
    return [len(e.encode_ordinary(t)) if t else 0 for t in texts]


def test_table_answers_every_limit(spark, documents):
    rng = random.Random(3)
    rows = hostile_rows() + [(100 + k, " ".join(rng.choices(["a", "word", "né", "\n", "  x"],
                                                            k=rng.randint(0, 3000))))
                             for k in range(120)]
    n = brute([r[1] for r in rows])
    table = T.limits(T.length_histogram(documents(rows).selectExpr("*", "1 AS n_tokens"))).cache()
    got = {r["length"]: r for r in table.collect()}
    assert sorted(got) == sorted(set(n)) and max(n) > 2 * T.BLOCK
    for limit, r in got.items():
        assert r["docs"] == n.count(limit) and r["tokens"] == limit * n.count(limit)
        assert r["docs_over"] == sum(x > limit for x in n)
        assert r["docs_reaching"] == sum(x >= limit for x in n)
        assert r["tokens_reaching"] == sum(x for x in n if x >= limit)
        assert r["tokens_truncated"] == sum(min(x, limit) for x in n)
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
        assert r["quantile"] == sum(x <= limit for x in n) / len(n)
    for limit in (0, 1, 7, 500, 10**9):
        assert T.at_limit(table, limit) == {
            "docs_over": sum(x > limit for x in n), "total_tokens": sum(n),
            "tokens_truncated": sum(min(x, limit) for x in n)}
    assert T.quantile(table, 0.5) == sorted(n)[(len(n) + 1) // 2 - 1]


def test_pieces_keep_the_count():
    rng, e = random.Random(4), T.load_encoding(Path(T.VOCABULARY).read_bytes())
    for _ in range(200):
        text = "".join(rng.choices(["a", "b's", " ", "  ", "\n", " \n", "é", "12", "!?", "\t"],
                                   k=60))
        parts = list(T.pieces(text, 5))
        assert "".join(parts) == text
        assert sum(len(e.encode_ordinary(p)) for p in parts) == len(e.encode_ordinary(text))


def test_empty(spark, documents):
    table = T.limits(T.length_histogram(documents([(1, "a")]).limit(0)))
    assert table.count() == 0 and T.at_limit(table, 5)["total_tokens"] == 0
    assert T.quantile(table, 0.5) is None
