"""Plan checks: everything stays JVM-side, top-k is TakeOrderedAndProject,
per-parent top-k is a partitioned window with a group limit, filters and
columns reach the scan, the period filter prunes partitions."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from periodlens import Periods, Selection
from periodlens.plans import analyses as A
from periodlens.operators import options as opt
from periodlens.plans import drilldown as D
from periodlens.sources import fixture_fact, load_periods, write_periods

from .conftest import SF_SMALL

P = E.P


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def fact(spark):
    return fixture_fact(spark, SF_SMALL, P)


TOPK = [n for n in E._SPARK if re.search(
    r"_(worst|best|loss|gain)$|^urun_(most|least)_|^stores_(most|least)_(units|revenue)$|"
    r"^stores_(falling|rising)_by_|^(stores|products)_top_margin$", n)]
BATCH = [n for n in E._SPARK if re.search(r"_all_(groups|products|product_groups)$", n)
         and n != "products_of_all_groups"]


@pytest.mark.parametrize("name", list(E._SPARK))
def test_no_python_in_plan(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                 "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in p, f"{name}: {node}"


@pytest.mark.parametrize("name", TOPK)
def test_topk_is_take_ordered(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p, name
    assert "RangePartitioning" not in p, name   # no global sort for a top-k


@pytest.mark.parametrize("name", BATCH)
def test_batch_topk_is_partitioned_window(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    # a partial group limit runs before the shuffle, so each task forwards at
    # most n rows per parent
    partial = p.index("WindowGroupLimit", p.index("row_number(), "))
    assert re.search(r"row_number\(\), \d+, Partial", p), name
    assert re.search(r"row_number\(\), \d+, Final", p), name
    assert partial > 0
    windows = re.findall(r"\(\d+\) Window\nInput.*\nArguments: \[[^\[\]]*\], \[([^\[\]]*)\]",
                         p)
    assert windows and all(w.strip() for w in windows), name


def test_selection_reaches_scan(spark, fact):
    p = plan(A.kpi_summary(fact, P, Selection(sm="ASIA")))
    assert "EqualTo(r_name,ASIA)" in p
    p = plan(A.group_analysis(fact, P, Selection(urun_grubu="PROMO")))
    assert "EqualTo(p_type,PROMO)" in p
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p


def test_partition_pruning_and_column_pruning(spark, fact, tmp_path):
    path = str(tmp_path / "fact")
    write_periods(fact, path)
    loaded = load_periods(spark, path, Periods(1999, 2000))
    p = plan(A.group_analysis(loaded, P, Selection(sm="ASIA")))
    assert re.search(r"PartitionFilters: \[.*yil.*IN \(1999,2000\)", p)
    assert "EqualTo(sm,ASIA)" in p
    read = re.findall(r"ReadSchema: struct<(.*)>", p)
    cols = set(re.findall(r"(?:^|,)(\w+):", read[0]))
    assert cols == {"sm", "ust_mal", "mal_grubu", "adet", "ciro", "marj", "fire"}


def test_heavy_aggregate_is_hash_based(spark, fact):
    p = plan(A.product_analysis(fact, P))
    # the pass over the fact is a hash aggregate; the label fold runs after the
    # key-grain shuffle
    assert p.index("HashAggregate") < p.rindex("Exchange")
    assert "HashAggregate" in p


def test_no_broadcast_hints(spark):
    """Broadcasts come only from Spark's own size checks, never from hints."""
    for name in E._SPARK:
        p = plan(E.queries()[name](spark, SF_SMALL), "extended")
        assert "ResolvedHint" not in p and "BROADCAST" not in p.upper().split("== PHYSICAL")[0], name


def test_keyed_drilldown_skips_row_groups(spark, fact, tmp_path):
    import glob

    import pyarrow.parquet as pq
    path = str(tmp_path / "fact_rg")
    write_periods(fact, path, **{"parquet.block.size": 8 * 1024})
    loaded = load_periods(spark, path, Periods(1999, 2000))
    p = plan(D.falling_stores(loaded, P, "mal_grubu", E.MG))
    assert f"EqualTo(mal_grubu,{E.MG})" in p
    total = covering = 0
    for f in glob.glob(path + "/yil=*/*.parquet"):
        md = pq.ParquetFile(f).metadata
        col = md.schema.names.index("mal_grubu")
        for i in range(md.num_row_groups):
            st = md.row_group(i).column(col).statistics
            total += 1
            covering += st.min <= E.MG <= st.max
    assert total >= 8 and covering <= max(2, total // 4), (covering, total)


def test_chosen_bs_reaches_the_scan(spark, fact, tmp_path):
    path = str(tmp_path / "fact_bs")
    write_periods(fact, path)
    p = plan(opt.stores_of(load_periods(spark, path, P), E.BS))
    assert re.search(rf"PushedFilters: \[.*EqualTo\(bs,{E.BS}\)", p)


def test_named_stores_need_one_pass_over_the_fact(spark, fact, monkeypatch):
    from periodlens.plans import page
    built = []
    real = page.grain_base
    monkeypatch.setattr(page, "grain_base", lambda *a, **k: built.append(1) or real(*a, **k))
    p = plan(D.falling_stores_named(fact, P))
    assert built == [1] and "lineitem" not in p


@pytest.mark.parametrize("n", [5, 5000])
def test_rows_are_limited_before_the_parent_exchange(spark, fact, n):
    p = plan(D.falling_stores(fact, P, "mal_grubu", n=n))
    if n <= 1000:
        assert re.search(r"row_number\(\), \d+, Partial", p)
    else:  # ranked per part of a parent first
        windows = [m for m in re.findall(r"\(\d+\) Window\n.*\nArguments: .*", p)]
        assert len(windows) == 2 and "__part" in windows[0] and "__part" not in windows[1]


def test_large_lists_of_a_hot_parent(spark, mkfact):
    import random
    rng = random.Random(4)
    f = mkfact([dict(magaza_kod=f"M{k}", mal_grubu="hot" if k % 10 else "cold",
                     yil=2024 + y, adet=float(rng.randint(0, 50)))
                for k in range(1500) for y in (0, 1)])
    pp = Periods(2024, 2025)
    whole = D.falling_stores(f, pp, "mal_grubu", n=1_000_000).collect()
    for n in (1001, 1200):
        got = D.falling_stores(f, pp, "mal_grubu", n=n).collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r) for r in whole if r.sira <= n)
