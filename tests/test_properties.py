"""Properties on generated facts (fixed seed) and on the test tables."""

import random

import pytest

from periodlens import Periods, Selection, normalise
from periodlens.operators.options import distinct_values
from periodlens.plans import analyses as A
from periodlens.plans import drilldown as D
from periodlens.sources import fixture_fact

from .conftest import SF_SMALL

P = Periods(2024, 2025)
NOF = Selection(min_ciro=0)


@pytest.fixture(scope="module")
def gen_fact(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(3000):
        g = rnd.randrange(12)
        rows.append(dict(
            sm=f"S{rnd.randrange(3)}", bs=f"B{rnd.randrange(6)}",
            magaza_kod=f"M{rnd.randrange(25)}", magaza_ad=f"Store {rnd.randrange(30)}",
            nitelik=f"N{rnd.randrange(1, 6)}", urun_grubu=f"U{g % 4}",
            ust_mal=f"U{g % 4}/{g % 6}", mal_grubu=f"G{g}", urun_kod=f"P{rnd.randrange(80)}",
            urun_ad=f"Name {rnd.randrange(90)}", yil=rnd.choice((2024, 2025)),
            # quarter units: every sum is exact in binary, any order
            adet=rnd.randrange(0, 200) / 4, ciro=rnd.randrange(-50, 2000) / 4,
            marj=rnd.randrange(-400, 400) / 4, fire=rnd.randrange(-40, 40) / 4,
            envanter=rnd.randrange(-40, 40) / 4, kampanya_zarar=rnd.randrange(-40, 10) / 4))
    from periodlens.schema import FACT_SCHEMA
    data = [tuple(r[f.name] for f in FACT_SCHEMA.fields) for r in rows]
    return normalise(spark.createDataFrame(data, FACT_SCHEMA)).cache()


@pytest.mark.parametrize("key_fn,key", [(A.group_analysis, "mal_grubu"),
                                        (A.product_group_analysis, "urun_grubu"),
                                        (A.product_analysis, "urun_kod")])
def test_group_sums_equal_kpi(gen_fact, key_fn, key):
    k = A.kpi_summary(gen_fact, P).first()
    rows = key_fn(gen_fact, P, NOF).collect()
    for m in ("adet", "ciro", "marj", "fire"):
        for t in ("prev", "cur"):
            assert sum(r[f"{m}_{t}"] for r in rows) == k[f"{m}_{t}"], (key, m, t)


def test_filter_split_adds_up(gen_fact):
    whole = A.kpi_summary(gen_fact, P).first()
    parts = [A.kpi_summary(gen_fact, P, Selection(sm=r.sm)).first()
             for r in distinct_values(gen_fact, "sm").collect()]
    for c in ("adet_cur", "ciro_prev", "marj_cur", "fire_prev"):
        assert sum(p[c] for p in parts) == whole[c]


@pytest.mark.parametrize("name,parent", [("stores_most_units", "urun_kod"),
                                         ("stores_least_revenue", "urun_kod"),
                                         ("stores_top_margin", "mal_grubu"),
                                         ("products_top_margin", "mal_grubu")])
def test_batch_equals_keyed(gen_fact, name, parent):
    batch = D.named(name, gen_fact, P).drop("sira").collect()
    by_parent = {}
    for r in batch:
        by_parent.setdefault(r[parent], set()).add(tuple(r))
    for key in sorted(by_parent)[:6]:
        keyed = {tuple(r) for r in D.named(name, gen_fact, P, key).collect()}
        assert keyed == by_parent[key], key


@pytest.mark.parametrize("parent", ["mal_grubu", "urun_grubu", "urun_kod"])
def test_batch_equals_keyed_falling_rising(gen_fact, parent):
    for fn in (D.falling_stores, D.rising_stores):
        batch = fn(gen_fact, P, parent).drop("sira").collect()
        keys = sorted({r[parent] for r in batch})[:4]
        for key in keys:
            keyed = {tuple(r) for r in fn(gen_fact, P, parent, key).collect()}
            assert keyed == {tuple(r) for r in batch if r[parent] == key}


def test_worst_best_reverse(gen_fact):
    g = A.group_analysis(gen_fact, P, NOF)
    n = g.count()
    w = [r.adet_deg for r in A.worst(g, "mal_grubu", n).collect()]
    b = [r.adet_deg for r in A.best(g, "mal_grubu", n).collect()]
    assert w == list(reversed(b))
    assert w == sorted(w)


def test_top_n_is_prefix_of_full_sort(gen_fact):
    u = A.product_analysis(gen_fact, P, NOF)
    full = [r.urun_kod for r in A.worst(u, "urun_kod", 10_000).collect()]
    assert [r.urun_kod for r in A.worst(u, "urun_kod", 7).collect()] == full[:7]


def test_fixture_counts(spark):
    f = fixture_fact(spark, SF_SMALL, Periods(1999, 2000))
    assert f.count() == 1782
    assert distinct_values(f, "mal_grubu").count() == 149
    assert distinct_values(f, "urun_kod").count() == 200


def test_page_on_product_base_equals_page_on_fact(gen_fact, mkfact):
    from periodlens.plans.page import page, product_base, run_page
    extra = normalise(mkfact([dict(mal_grubu="", urun_kod="", adet=3.0),
                              dict(urun_kod="PX", adet=None, ciro=None),
                              dict(yil=2023, urun_kod="OLD", adet=9.0),
                              dict(urun_ad=None, urun_kod="P1", adet=1.0)]))
    fact = gen_fact.unionByName(extra)
    for sel in (Selection(min_ciro=0), Selection(sm="S1", min_ciro=100)):
        base = product_base(fact, P, sel)
        a, b = page(fact, P, sel), page(fact, P, sel, base)
        for k in a:
            assert sorted(map(tuple, a[k].collect())) == sorted(map(tuple, b[k].collect())), k
    got = run_page(fact, P, lambda name, df: df.count(), NOF, parallel=3)
    assert got == {k: v.count() for k, v in page(fact, P, NOF).items()}
