import math

import pytest
from pyspark.sql import functions as F

from periodlens.llm import queries as Q
from periodlens.llm import rule_ensemble as R
from periodlens.llm.text_stats import with_text_counts

from ..conftest import SF_SMALL
from .conftest import hostile_rows


def stats_of(docs):
    return R.with_statistics(with_text_counts(docs))


def test_compiled_rules_equal_their_conjunctions(spark, documents):
    docs = documents([(k, "word " * (k % 40) + "!! " * (k % 7)) for k in range(200)])
    rows = stats_of(docs).withColumn("label", (F.col("doc_id") % 7 < 4).cast("int")).cache()
    model = R.fit(rows)
    assert model.rules and any(len(r) > 1 for _, r in model.rules)
    for r in rows.withColumn("score", model.score()).collect():
        total = model.bias + sum(w for w, rule in model.rules if all(
            r["stats"][k] <= x if s == "<=" else r["stats"][k] > x for k, s, x in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))
        assert (r["score"] > 0.5) == (r["label"] == 1)
    assert all(" if " in x for x in model.describe())


def test_tightened_keeps_one_bound_per_side():
    assert R.tightened(((1, "<=", 5.0), (0, ">", 1.0), (1, "<=", 3.0), (0, ">", 2.0),
                        (1, ">", 0.0))) == ((0, ">", 2.0), (1, "<=", 3.0), (1, ">", 0.0))


def test_lasso_leaves_out_rules(spark, documents):
    docs = documents([(k, "word " * (20 + k % 40) + "!! " * (k % 7)) for k in range(200)])
    rows = stats_of(docs).withColumn("label", (F.col("doc_id") % 7 < 4).cast("int"))
    few, many = R.fit(rows, lasso=0.1), R.fit(rows, lasso=1e-4)
    assert len(few.rules) < len(many.rules)


def test_without_labels_or_with_one_class(spark, documents):
    rows = stats_of(documents(hostile_rows()))
    label = lambda x: rows.withColumn("label", F.lit(x).cast("int"))
    assert R.fit(label(None)).score is not None
    assert {r[0] for r in rows.select(R.fit(label(None)).score()).collect()} == {0.5}
    n = rows.count()
    got = {round(r[0], 9) for r in rows.select(R.fit(label(1)).score()).collect()}
    assert got == {round((n + 1) / (n + 2), 9)}
    assert rows.limit(0).select(R.fit(rows.limit(0).withColumn("label", F.lit(1))).score()
                                ).count() == 0


def test_query_on_held_out_rows(spark):
    got = Q.QUERIES["op1_rule_ensemble"](spark, SF_SMALL)
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_rules_are_the_ways_through_the_fitted_trees(spark, documents, monkeypatch):
    """A row satisfies a rule where, and only where, it passes a node of that way."""
    docs = documents([(k, "word " * (20 + k % 40) + "Ab1 " * (k % 11) + "!! " * (k % 7))
                      for k in range(150)])
    rows = stats_of(docs).withColumn("label", (F.col("doc_id") % 7 < 4).cast("int")).cache()
    seen = []
    taken = R.tree_rules
    monkeypatch.setattr(R, "tree_rules", lambda model: seen.append(model) or taken(model))
    R.fit(rows)
    rules = taken(seen[0])
    assert len(rules) == len(set(rules)) > 10
    for r in rows.collect():
        passed = set()
        for tree in seen[0]._java_obj.trees():
            node, way = tree.rootNode(), ()
            while node.numDescendants():
                k, limit = node.split().featureIndex(), node.split().threshold()
                left = r["stats"][k] <= limit
                way += ((k, "<=" if left else ">", limit),)
                passed.add(R.tightened(way))
                node = node.leftChild() if left else node.rightChild()
        true = {rule for rule in rules if all(
            r["stats"][k] <= x if s == "<=" else r["stats"][k] > x for k, s, x in rule)}
        assert passed == true
