"""Row order of the sorted results (SRT-1, SRT-2, keyed TOP-8..13)."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL


def rows(spark, name):
    return E.queries()[name](spark, SF_SMALL).collect()


@pytest.mark.parametrize("name,columns", [
    ("options_sm", ["sm"]), ("options_nitelik", ["nitelik"]),
    ("options_urun_grubu", ["urun_grubu"]), ("options_bs_by_sm", ["sm", "bs"]),
    ("options_ust_by_urun_grubu", ["urun_grubu", "ust_mal"]),
    ("options_mal_by_ust", ["ust_mal", "mal_grubu"]),
    ("options_store_by_bs", ["bs", "magaza_kod", "magaza_ad"]),
    ("options_children_all", ["mal_grubu"]), ("options_children_of", ["mal_grubu"])])
def test_options_ascend(spark, name, columns):
    got = [tuple(r[c] for c in columns) for r in rows(spark, name)]
    assert got == sorted(got) and got


@pytest.mark.parametrize("name,lead,by,child", [
    ("products_of_group", [], "adet_cur", "urun_kod"),
    ("products_of_all_groups", ["mal_grubu"], "adet_cur", "urun_kod"),
    ("groups_of_urun_grubu", [], "adet_cur", "mal_grubu")])
def test_full_lists(spark, name, lead, by, child):
    got = [(*[r[c] for c in lead], -r[by], r[child]) for r in rows(spark, name)]
    assert got == sorted(got) and got


@pytest.mark.parametrize("name,by,sign,child", [
    ("stores_falling_by_mal", "adet_fark", 1, "magaza_kod"),
    ("stores_rising_by_mal", "adet_fark", -1, "magaza_kod"),
    ("stores_falling_by_ug", "adet_fark", 1, "magaza_kod"),
    ("stores_rising_by_urun", "adet_fark", -1, "magaza_kod"),
    ("stores_most_units", "adet_cur", -1, "magaza_kod"),
    ("stores_least_units", "adet_cur", 1, "magaza_kod"),
    ("stores_most_revenue", "ciro_cur", -1, "magaza_kod"),
    ("stores_least_revenue", "ciro_cur", 1, "magaza_kod"),
    ("stores_top_margin", "marj_cur", -1, "magaza_kod"),
    ("products_top_margin", "marj_cur", -1, "urun_kod")])
def test_keyed_lists(spark, name, by, sign, child):
    got = [(sign * r[by], r[child]) for r in rows(spark, name)]
    assert got == sorted(got) and got
