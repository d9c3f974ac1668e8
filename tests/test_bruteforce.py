"""Brute force on a small skewed fixture: one merchandise group and one store
hold ~40% of the rows. Spark results are compared with a direct pandas
computation of the same definitions (quarter-unit values keep every sum
exact in any order)."""

import math
import random

import pandas as pd
import pytest

from periodlens import Periods, Selection, normalise
from periodlens.operators import margin_reasons
from periodlens.plans import analyses as A
from periodlens.plans import drilldown as D
from periodlens.schema import FACT_SCHEMA

P = Periods(2024, 2025)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        hot = rnd.random() < 0.4
        g = "HOT" if hot else f"G{rnd.randrange(20)}"
        rows.append(dict(
            sm=f"S{rnd.randrange(3)}", bs=f"B{rnd.randrange(5)}",
            magaza_kod="M0" if hot else f"M{rnd.randrange(1, 40)}",
            magaza_ad=f"Store {rnd.randrange(3)}", nitelik="N1", urun_grubu="U0" if hot else f"U{int(g[1:]) % 3}",
            ust_mal=f"UM{rnd.randrange(2)}", mal_grubu=g, urun_kod=f"P{rnd.randrange(60)}",
            urun_ad=f"Name {rnd.randrange(5)}", yil=rnd.choice((2024, 2025)),
            adet=None if rnd.random() < 0.02 else rnd.randrange(0, 120) / 4,
            ciro=rnd.randrange(-20, 4000) / 4, marj=rnd.randrange(-300, 300) / 4,
            fire=float("nan") if rnd.random() < 0.01 else rnd.randrange(-40, 20) / 4,
            envanter=rnd.randrange(-40, 40) / 4, kampanya_zarar=rnd.randrange(-40, 5) / 4))
    data = [tuple(r[f.name] for f in FACT_SCHEMA.fields) for r in rows]
    schema = FACT_SCHEMA.__class__([f.__class__(f.name, f.dataType, True)
                                    for f in FACT_SCHEMA.fields])
    fact = normalise(spark.createDataFrame(data, schema)).cache()
    pdf = pd.DataFrame(rows)
    pdf["fire"] = pdf["fire"].where(~pdf["fire"].isna(), None)
    return fact, pdf


def _pct(prev, cur, no_base=0.0):
    if prev is not None and not pd.isna(prev) and prev > 0:
        return None if cur is None or pd.isna(cur) else (cur / prev - 1) * 100
    return no_base


def _sum_or_none(s):
    s = s.dropna()
    return float(s.sum()) if len(s) else None


def brute_two_period(pdf, keys, labels, measures):
    pdf = pdf[pdf.yil.isin(P.years)]
    out = []
    for k, g in pdf.groupby(keys, sort=False):
        k = k if isinstance(k, tuple) else (k,)
        row = dict(zip(keys, k))
        for lbl in labels:
            row[lbl] = g[lbl].max()
        for m in measures:
            src = {"kampanya": "kampanya_zarar"}.get(m, m)
            v = g[src].abs() if m in ("fire", "envanter", "kampanya") else g[src]
            for tag, y in (("prev", P.prev), ("cur", P.cur)):
                # CASE WHEN yil = y THEN v ELSE 0: null only if every row gives null
                vals = v.where(g.yil == y, 0.0)
                row[f"{m}_{tag}"] = _sum_or_none(vals)
        out.append(row)
    return out


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)


def test_group_analysis_matches_brute_force(skewed):
    fact, pdf = skewed
    got = {r.mal_grubu: r for r in A.group_analysis(fact, P, Selection(min_ciro=1000))
           .collect()}
    want = [r for r in brute_two_period(pdf[pdf.mal_grubu != ""], ["mal_grubu"], ["ust_mal"],
                                        ["adet", "ciro", "marj", "fire"])
            if r["ciro_cur"] is not None and r["ciro_cur"] >= 1000]
    assert set(got) == {r["mal_grubu"] for r in want}
    for w in want:
        g = got[w["mal_grubu"]]
        assert g.ust_mal == w["ust_mal"]
        for m in ("adet", "ciro", "marj", "fire"):
            assert _close(g[f"{m}_prev"], w[f"{m}_prev"]) and _close(g[f"{m}_cur"], w[f"{m}_cur"])
            assert _close(g[f"{m}_deg"], _pct(w[f"{m}_prev"], w[f"{m}_cur"]))


def test_falling_stores_all_groups_matches_brute_force(skewed):
    fact, pdf = skewed
    got = {}
    for r in D.falling_stores(fact, P, "mal_grubu").collect():
        got.setdefault(r.mal_grubu, []).append((r.sira, r.magaza_kod))
    rows = [r for r in brute_two_period(pdf[pdf.mal_grubu != ""], ["mal_grubu", "magaza_kod"],
                                        ["magaza_ad", "bs"], ["adet", "ciro", "marj"])
            if r["adet_prev"] is not None and r["adet_prev"] > 0]
    want = {}
    for r in rows:
        fark = None if r["adet_cur"] is None else r["adet_cur"] - r["adet_prev"]
        want.setdefault(r["mal_grubu"], []).append((fark is None, fark or 0, r["magaza_kod"]))
    assert set(got) == set(want)
    for g, cands in want.items():
        top = [c[2] for c in sorted(cands)[:5]]
        assert [m for _, m in sorted(got[g])] == top, g


def test_margin_reasons_match_brute_force(skewed):
    fact, pdf = skewed
    gm = A.group_margin(fact, P, Selection(min_ciro=0))
    got = {}
    for r in margin_reasons(gm, ["mal_grubu"]).collect():
        got.setdefault(r.mal_grubu, []).append((r.neden_sira, r.kural, r.oncelik))
    base = brute_two_period(pdf[pdf.mal_grubu != ""], ["mal_grubu"], ["ust_mal"],
                            ["marj", "ciro", "adet", "fire", "envanter", "kampanya"])
    want = {}
    z = lambda v: 0.0 if v is None else v
    for r in base:
        if not (z(r["marj_cur"]) - z(r["marj_prev"]) < 0):
            continue
        af = z(r["adet_cur"]) - z(r["adet_prev"])
        ef = z(r["envanter_cur"]) - z(r["envanter_prev"])
        ff = abs(z(r["fire_cur"])) - abs(z(r["fire_prev"]))
        kf = abs(z(r["kampanya_cur"])) - abs(z(r["kampanya_prev"]))
        found = []
        if af < 0:
            found.append((1, abs(af) + kf) if kf > 0 else (2, abs(af)))
        if ef > 0:
            found.append((3, ef))
        if ff > 0:
            found.append((4, ff))
        if kf > 0 and af >= 0:
            found.append((5, kf))
        found.sort(key=lambda x: -x[1])     # stable: rule order among equals
        want[r["mal_grubu"]] = ([(i + 1, k, p) for i, (k, p) in enumerate(found[:2])]
                                or [(1, None, None)])
    assert set(got) == set(want)
    for g in want:
        assert sorted(got[g]) == want[g], g
