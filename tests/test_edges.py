"""Hand-written edge rows E1-E20 (FIXTURES.md §3), expected values by hand."""

import math

import pytest
from periodlens import Periods, Selection, normalise
from periodlens.operators import margin_reasons, reason_rule, with_reason
from periodlens.operators.options import store_options
from periodlens.plans import analyses as A
from periodlens.plans import drilldown as D

P = Periods(2024, 2025)
NOF = Selection(min_ciro=0)


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}


def test_e1_new_entrant(mkfact):
    f = normalise(mkfact([dict(yil=2025, adet=10.0, ciro=100.0)]))
    g = rows_by(A.group_analysis(f, P, NOF), "mal_grubu")["UG/A/x"]
    assert g.adet_prev == 0.0 and g.adet_cur == 10.0 and g.adet_deg == 0.0
    rise = D.rising_stores(f, P, "mal_grubu", "UG/A/x").collect()
    assert len(rise) == 1 and rise[0].adet_deg == 100.0 and rise[0].ciro_deg == 100.0
    assert D.falling_stores(f, P, "mal_grubu", "UG/A/x").count() == 0


def test_e2_negative_base(mkfact):
    f = normalise(mkfact([dict(yil=2024, marj=-5.0), dict(yil=2025, marj=10.0)]))
    g = A.group_analysis(f, P, NOF).first()
    assert g.marj_deg == 0.0
    m = A.group_margin(f, P, NOF).first()
    assert m.marj_fark == 15.0 and m.marj_deg == 0.0


def test_e3_vanished(mkfact):
    f = normalise(mkfact([dict(yil=2024, adet=10.0, ciro=50.0)]))
    assert A.group_analysis(f, P, NOF).first().adet_deg == -100.0
    fall = D.falling_stores(f, P, "mal_grubu", "UG/A/x").collect()
    assert len(fall) == 1 and fall[0].adet_fark == -10.0


def test_e4_zero_both_years(mkfact):
    f = normalise(mkfact([dict(yil=2024, adet=0.0), dict(yil=2025, adet=0.0)]))
    assert D.rising_stores(f, P, "mal_grubu", "UG/A/x").count() == 0
    assert A.least(A.products_by_units(f, P), "urun_kod", "adet_cur", 20).count() == 0


def test_e5_mixed_sign_waste(mkfact):
    f = normalise(mkfact([dict(yil=2025, fire=-3.0), dict(yil=2025, fire=2.0,
                                                          magaza_kod="M2")]))
    assert A.group_analysis(f, P, NOF).first().fire_cur == 5.0
    assert A.kpi_summary(f, P).first().fire_cur == 5.0


def test_e6_e7_empty_and_null_key(mkfact):
    f = normalise(mkfact([dict(mal_grubu="", adet=1.0), dict(mal_grubu=None, adet=2.0),
                          dict(mal_grubu="G", adet=4.0)]))
    groups = [r.mal_grubu for r in A.group_analysis(f, P, NOF).collect()]
    assert groups == ["G"]
    assert A.kpi_summary(f, P).first().adet_cur == 7.0


def test_e8_null_measure(mkfact):
    f = normalise(mkfact([dict(urun_kod="A", adet=None), dict(urun_kod="B", adet=3.0),
                          dict(urun_kod="B", yil=2024, adet=1.0)]))
    r = rows_by(A.products_by_units(f, P), "urun_kod")
    assert r["A"].adet_cur is None and r["A"].adet_prev == 0.0 and r["A"].adet_deg == 0.0
    most = [x.urun_kod for x in A.most(A.products_by_units(f, P), "urun_kod", "adet_cur", 5)
            .collect()]
    assert most == ["B", "A"]  # null sorts last


def test_e9_nan_measure(mkfact):
    f = normalise(mkfact([dict(adet=float("nan")), dict(adet=2.0, magaza_kod="M2")]))
    g = A.group_analysis(f, P, NOF).first()
    assert g.adet_cur == 2.0 and not math.isnan(g.adet_cur)


def test_e10_floor_zero_keeps_negative(mkfact):
    f = normalise(mkfact([dict(ciro=-50.0)]))
    assert A.group_analysis(f, P, Selection(min_ciro=0)).count() == 1
    assert A.group_analysis(f, P, Selection(min_ciro=1)).count() == 0


def test_e11_floor_scaling(mkfact):
    f = normalise(mkfact([dict(ciro=2500.0)]))
    s = Selection(min_ciro=10000)
    assert A.group_analysis(f, P, s).count() == 0
    assert A.product_analysis(f, P, s).count() == 1      # floor / 5 = 2000
    assert A.product_margin(f, P, s).count() == 1        # floor / 10 = 1000
    assert A.group_margin(f, P, s).count() == 0


def test_e12_ties_by_key(mkfact):
    rows = [dict(mal_grubu=g, yil=y, adet=a) for g in ("c", "a", "b", "d")
            for y, a in ((2024, 10.0), (2025, 5.0))]
    f = normalise(mkfact(rows))
    w = [r.mal_grubu for r in A.worst(A.group_analysis(f, P, NOF), "mal_grubu", 2).collect()]
    assert w == ["a", "b"]
    b = [r.mal_grubu for r in A.best(A.group_analysis(f, P, NOF), "mal_grubu", 3).collect()]
    assert b == ["a", "b", "c"]


def test_e13_two_labels(mkfact):
    f = normalise(mkfact([dict(magaza_ad="Alpha", adet=1.0),
                          dict(magaza_ad="Beta", adet=2.0, urun_kod="P2")]))
    st = D.named("stores_most_units", f, P, "P1").collect()
    assert st[0].magaza_ad == "Alpha"
    st = D.named("stores_most_units", f, P, None).collect()
    names = {r.magaza_ad for r in st}
    assert names == {"Alpha", "Beta"}
    pairs = store_options(f).collect()
    assert [(p.magaza_kod, p.magaza_ad) for p in pairs] == [("M1", "Alpha"), ("M1", "Beta")]
    # the label is the max over both names when both are under one key
    f2 = normalise(mkfact([dict(magaza_ad="Alpha", adet=1.0), dict(magaza_ad="Beta", adet=2.0)]))
    assert D.named("stores_most_units", f2, P, "P1").first().magaza_ad == "Beta"


def test_e14_same_group_two_parents(mkfact):
    f = normalise(mkfact([dict(mal_grubu="X", ust_mal="A"), dict(mal_grubu="X", ust_mal="B")]))
    r = A.group_analysis(f, P, NOF).collect()
    assert len(r) == 1 and r[0].ust_mal == "B"


def test_e15_quote_in_value(mkfact):
    f = normalise(mkfact([dict(mal_grubu="L'Oreal", adet=3.0, yil=2024),
                          dict(mal_grubu="L'Oreal", adet=1.0)]))
    s = Selection(mal_grubu="L'Oreal", min_ciro=0)
    assert A.group_analysis(f, P, s).count() == 1
    assert D.falling_stores(f, P, "mal_grubu", "L'Oreal").count() == 1


def test_e16_third_year_ignored(mkfact):
    f = normalise(mkfact([dict(yil=2023, adet=100.0, mal_grubu="OLD"), dict(adet=1.0)]))
    k = A.kpi_summary(f, P).first()
    assert k.adet_prev == 0.0 and k.adet_cur == 1.0
    assert [r.mal_grubu for r in A.group_analysis(f, P, NOF).collect()] == ["UG/A/x"]


def test_e17_empty_selection(mkfact):
    f = normalise(mkfact([dict(adet=1.0, ciro=5.0)]))
    s = Selection(sm="nobody", min_ciro=0)
    k = A.kpi_summary(f, P, s).first()
    assert all(k[c] == 0.0 for c in k.asDict())
    g = A.group_analysis(f, P, s)
    assert g.count() == 0 and "adet_deg" in g.columns


def test_e18_no_margin_reason(mkfact):
    f = normalise(mkfact([dict(yil=2024, marj=10.0, adet=1.0), dict(yil=2025, marj=5.0,
                                                                   adet=1.0)]))
    r = margin_reasons(A.group_margin(f, P, NOF), ["mal_grubu"]).collect()
    assert len(r) == 1 and r[0].kural is None and r[0].oncelik is None
    assert r[0].neden_sira == 1 and "Belirgin" in r[0].neden


def test_margin_reason_priority_and_text(mkfact):
    f = normalise(mkfact([
        dict(yil=2024, marj=100.0, adet=10.0, kampanya_zarar=-5.0, fire=1.0, envanter=2.0),
        dict(yil=2025, marj=50.0, adet=4.0, kampanya_zarar=-8.0, fire=-30.0, envanter=3.0)]))
    r = margin_reasons(A.group_margin(f, P, NOF), ["mal_grubu"]).collect()
    # fire rise 29 > units fall 6 + campaign 3 = 9 > inventory 1
    assert [x.kural for x in r] == [4, 1]
    assert [x.oncelik for x in r] == [29.0, 9.0]
    assert r[1].aciklama == ("Satış: 10 → 4 (-60.0%)\nKampanya Zararı: ₺5 → ₺8 (+₺3)")
    assert r[0].aciklama == "Fire: ₺1 → ₺30 (+₺29, +2900.0%)"


def test_e19_rule_order(spark):
    df = spark.createDataFrame([(60.0, -30.0, 0.0)], "fire_deg double, adet_deg double, "
                               "marj_deg double")
    assert df.select(reason_rule(df).alias("k")).first().k == 1


@pytest.mark.parametrize("fire,adet,marj,expected", [
    (50.0, 0.0, 0.0, 7),     # fire exactly 50: rule 1 does not fire
    (0.0, -15.0, 0.0, 6),    # adet exactly -15: not rule 2, but below 0
    (0.0, 20.0, 0.0, 7),     # adet exactly 20: not rule 5
    (0.0, 0.0, 0.0, 7),      # adet exactly 0: not rule 6
    (0.0, 0.0, -20.0, 7),    # marj exactly -20: not rule 4
    (35.0, -12.0, 0.0, 3),   # stock rule
    (10.0, 25.0, -25.0, 4),  # margin before success
    (None, None, None, 7),   # missing -> 0
])
def test_e20_threshold_edges(spark, fire, adet, marj, expected):
    df = spark.createDataFrame([(fire, adet, marj)], "fire_deg double, adet_deg double, "
                               "marj_deg double")
    out = with_reason(df).first()
    assert out.neden_kod == expected


def test_kpi_polarity(mkfact):
    f = normalise(mkfact([dict(yil=2024, adet=10.0, fire=1.0), dict(yil=2025, adet=5.0,
                                                                   fire=2.0)]))
    t = {r.metrik: r for r in A.kpi_trend(f, P).collect()}
    assert t["adet"].yon == "down" and t["fire"].yon == "down"
    assert t["ciro"].yon == "down"  # 0 change reads down for a normal measure
    f2 = normalise(mkfact([dict(yil=2024, fire=2.0), dict(yil=2025, fire=2.0)]))
    t2 = {r.metrik: r for r in A.kpi_trend(f2, P).collect()}
    assert t2["fire"].yon == "up"   # ... and up for waste


def test_batch_excludes_empty_parent(mkfact):
    f = normalise(mkfact([dict(mal_grubu="", yil=2024, adet=5.0),
                          dict(mal_grubu="G", yil=2024, adet=5.0)]))
    out = D.falling_stores(f, P, "mal_grubu").collect()
    assert [r.mal_grubu for r in out] == ["G"]


def test_margin_kpi_values(mkfact):
    f = normalise(mkfact([dict(yil=2024, marj=20.0, ciro=100.0),
                          dict(yil=2025, marj=30.0, ciro=200.0)]))
    k = A.margin_kpi(f, P).first()
    assert (k.marj_fark, k.marj_oran_prev, k.marj_oran_cur) == (10.0, 20.0, 15.0)
    assert k.marj_oran_fark == -5.0 and k.marj_deg == pytest.approx(50.0)


def test_selection_text():
    assert Selection().text() == "Tüm Veriler"
    assert Selection(sm="A", bs="Tümü", nitelik="N2").text() == "SM: A | Nitelik: N2"
    assert Selection(magaza="7", mal_grubu="x").predicate() is not None
    assert Selection(sm="", bs=None).predicate() is None


def test_decimal_measures_exact(spark):
    from decimal import Decimal
    rows = [("S", "B", "M", "m", "N1", "U", "U/a", "U/a/x", "P", "p", 2025,
             Decimal("0.10"), Decimal("0.20"), Decimal("0"), Decimal("0"), Decimal("0"),
             Decimal("0"))] * 3
    schema = ("sm string, bs string, magaza_kod string, magaza_ad string, nitelik string, "
              "urun_grubu string, ust_mal string, mal_grubu string, urun_kod string, "
              "urun_ad string, yil int, adet decimal(18,2), ciro decimal(18,2), "
              "marj decimal(18,2), fire decimal(18,2), envanter decimal(18,2), "
              "kampanya_zarar decimal(18,2)")
    f = normalise(spark.createDataFrame(rows, schema))
    g = A.group_analysis(f, P, NOF).first()
    assert g.adet_cur == 0.3 and g.ciro_cur == 0.6  # exact decimal sum, then double
