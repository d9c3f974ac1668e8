"""Loading: per-period files, load check, partitioned layout, reuse cache."""

import os

import pytest
from pyspark.sql import functions as F

from periodlens import Periods
from periodlens.schema import FactSchemaError
from periodlens.sources import (FactCache, FactLoadError, fixture_fact, load_periods,
                                period_counts, read_period_files, recover_periods, register,
                                replace_period, write_periods)
from periodlens.sources import periods

from .conftest import SF_SMALL

P = Periods(1999, 2000)

REF_NAMES = {"sm": "SM", "bs": "BS", "magaza_kod": "Magaza_Kod", "magaza_ad": "Magaza_Ad",
             "nitelik": "Nitelik", "urun_grubu": "Urun_Grubu", "ust_mal": "Ust_Mal",
             "mal_grubu": "Mal_Grubu", "urun_kod": "Urun_Kod", "urun_ad": "Urun_Ad",
             "adet": "Adet", "ciro": "Ciro", "marj": "Marj", "fire": "Fire",
             "envanter": "Envanter", "kampanya_zarar": "Kampanya_Zarar"}


@pytest.fixture(scope="module")
def fact(spark):
    return fixture_fact(spark, SF_SMALL, P)


def test_period_files_with_reference_names(spark, fact, tmp_path):
    paths = {}
    for y in P.years:
        p = str(tmp_path / f"veri_{y}.parquet")
        (fact.where(F.col("yil") == y).drop("yil")
             .select(*[F.col(c).alias(REF_NAMES[c]) for c in REF_NAMES]).write.parquet(p))
        paths[y] = p
    loaded = read_period_files(spark, paths)
    got = {r.yil: r.satir for r in period_counts(loaded).collect()}
    want = {r.yil: r.satir for r in period_counts(fact).collect()}
    assert got == want and sum(got.values()) == 1782
    assert set(loaded.columns) >= set(REF_NAMES)
    register(loaded)
    assert spark.sql("select count(*) c from veri").first().c == 1782


def test_missing_file(spark, tmp_path):
    with pytest.raises(FactLoadError):
        read_period_files(spark, {2024: str(tmp_path / "nope.parquet")})


def test_missing_column(spark, fact, tmp_path):
    p = str(tmp_path / "bad.parquet")
    fact.drop("marj").write.parquet(p)
    with pytest.raises(FactSchemaError):
        read_period_files(spark, {1999: p})
    with pytest.raises(FactLoadError):
        load_periods(spark, p)


def test_partitioned_round_trip(spark, fact, tmp_path):
    p = str(tmp_path / "fact")
    write_periods(fact, p)
    back = load_periods(spark, p, P)
    assert back.count() == fact.count()
    assert load_periods(spark, p, Periods(1999, 1998)).count() < fact.count()


def test_fact_cache_refresh(spark, fact):
    calls = []

    def loader():
        calls.append(1)
        return fact
    c = FactCache(loader, ttl_seconds=3600)
    a = c.get()
    assert c.get() is a and len(calls) == 1
    c.refresh()
    assert len(calls) == 2
    assert c.get().is_cached


def test_date_ranges():
    assert len(Periods(2024, 2025).date_ranges()) == 1
    assert len(Periods(2022, 2025).date_ranges()) == 2
    with pytest.raises(ValueError):
        Periods(2025, 2025)


def test_written_files_sorted_by_product_hierarchy(spark, fact, tmp_path):
    import glob

    import pyarrow.parquet as pq
    p = str(tmp_path / "fact_sorted")
    write_periods(fact.repartition(3), p)
    files = glob.glob(p + "/yil=*/*.parquet")
    assert files
    for f in files:
        t = pq.read_table(f, columns=["urun_grubu", "ust_mal", "mal_grubu", "urun_kod"])
        rows = list(zip(*[t.column(c).to_pylist() for c in t.column_names]))
        assert rows == sorted(rows)


def test_non_adjacent_periods_scan_two_ranges(spark):
    import duckdb

    from periodlens.plans import analyses as A
    pp = Periods(1996, 2000)
    f = fixture_fact(spark, SF_SMALL, pp)
    got = {r.yil: r.satir for r in period_counts(f).collect()}
    con = duckdb.connect()
    want = dict(con.execute(
        f"SELECT CAST(year(l_shipdate) AS INTEGER) y, count(*) FROM "
        f"read_parquet('{SF_SMALL}/lineitem.parquet') WHERE year(l_shipdate) IN (1996, 2000) "
        f"GROUP BY y").fetchall())
    assert got == want and set(got) == {1996, 2000}
    k = A.kpi_summary(f, pp).first()
    assert k.adet_prev > 0 and k.adet_cur > 0


def test_shared_dir_reads_session_setting(spark):
    from periodlens.session import scratch_path, shared_dir
    d = shared_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(d)


def kpis(fact):
    from periodlens.plans import analyses as A
    return [None if x is None else round(float(x), 6) for x in A.kpi_summary(fact, P).first()]


def test_writing_one_period_keeps_the_other(spark, fact, tmp_path):
    p = str(tmp_path / "fact")
    write_periods(fact, p)
    write_periods(fact.where("yil = 2000"), p)
    back = load_periods(spark, p, P)
    assert {r.yil: r.satir for r in period_counts(back).collect()} == {
        r.yil: r.satir for r in period_counts(fact).collect()}
    assert kpis(back) == kpis(fact)
    write_periods(fact.where("yil = 2000"), p, replace_all=True)
    assert [r.yil for r in period_counts(load_periods(spark, p)).collect()] == [2000]


def test_restated_period_replaces_its_rows(spark, fact, tmp_path):
    p = str(tmp_path / "fact")
    write_periods(fact, p)
    cache = FactCache(lambda: load_periods(spark, p, P), partitions=3)
    assert kpis(cache.get()) == kpis(fact)
    new = fact.where("yil = 2000 AND sm <> 'ASIA'").withColumn(
        "adet", (F.col("adet") * 3).cast(fact.schema["adet"].dataType))
    replace_period(new.drop("yil"), p, 2000)
    want = fact.where("yil = 1999").unionByName(new)
    assert kpis(cache.refresh()) == kpis(want)
    assert cache.get().rdd.getNumPartitions() == 3
    assert cache.get().count() == want.count()
    replace_period(new.limit(0), p, 2000)
    assert [r.yil for r in period_counts(load_periods(spark, p)).collect()] == [1999]
    with pytest.raises(FactLoadError):
        replace_period(fact, p, 2000)
    assert load_periods(spark, p).count() == fact.where("yil = 1999").count()


@pytest.fixture
def folder(spark, fact, tmp_path):
    p = str(tmp_path / "fact")
    write_periods(fact, p)
    return p


def rows_by_period(spark, p):
    return {r.yil: (r.n, r.adet) for r in load_periods(spark, p).groupBy("yil").agg(
        F.count(F.lit(1)).alias("n"), F.sum("adet").alias("adet")).collect()}


def hidden(p):
    return sorted(n for n in os.listdir(p) if n.startswith("_") and n != "_SUCCESS")


def plus_one(spark, p, yil):
    one = load_periods(spark, p).where(F.col("yil") == yil)
    return one.withColumn("adet", (F.col("adet") + 1).cast(one.schema["adet"].dataType))


def test_a_period_is_corrected_from_its_own_rows(spark, folder):
    before = rows_by_period(spark, folder)
    for _ in range(2):
        replace_period(plus_one(spark, folder, 2000), folder, 2000)
    n, adet = before[2000]
    assert rows_by_period(spark, folder) == {1999: before[1999], 2000: (n, adet + 2 * n)}
    assert hidden(folder) == []


def test_a_new_period_joins_the_folder(spark, fact, folder):
    before = rows_by_period(spark, folder)
    replace_period(fact.where("yil = 2000").drop("yil"), folder, 2001)
    assert rows_by_period(spark, folder) == before | {2001: before[2000]}


class Stop(Exception):
    pass


def stop(*_):
    raise Stop


def test_failure_before_the_swap_changes_nothing(spark, folder, monkeypatch):
    before = rows_by_period(spark, folder)
    monkeypatch.setattr(periods, "_check_written", stop)  # after the write
    with pytest.raises(Stop):
        replace_period(plus_one(spark, folder, 2000), folder, 2000)
    assert rows_by_period(spark, folder) == before and hidden(folder) == []


def test_rows_missing_after_the_write_are_refused(spark, fact, folder, monkeypatch):
    before, read = rows_by_period(spark, folder), periods._read
    monkeypatch.setattr(periods, "_read", lambda s, p: (
        read(s, p).limit(5) if periods._NEW in p else read(s, p)))
    with pytest.raises(FactLoadError):
        replace_period(plus_one(spark, folder, 1999), folder, 1999)
    assert rows_by_period(spark, folder) == before and hidden(folder) == []


def test_failure_of_the_write_changes_nothing(spark, folder):
    before = rows_by_period(spark, folder)
    bad = plus_one(spark, folder, 2000).withColumn(
        "adet", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception):
        replace_period(bad, folder, 2000)
    assert rows_by_period(spark, folder) == before and hidden(folder) == []


@pytest.mark.parametrize("after", [1, 2])
def test_failure_between_the_renames_puts_the_period_back(spark, folder, monkeypatch, after):
    before, rename, calls = rows_by_period(spark, folder), periods._rename, []

    def failing(fs, source, target):
        calls.append(1)
        if len(calls) == after:
            raise Stop
        rename(fs, source, target)
    monkeypatch.setattr(periods, "_rename", failing)
    with pytest.raises(Stop):
        replace_period(plus_one(spark, folder, 2000), folder, 2000)
    assert rows_by_period(spark, folder) == before and hidden(folder) == []


def test_process_that_ends_between_the_renames(spark, folder):
    """Both other periods and the one set aside can be read, and it can be put back."""
    before = rows_by_period(spark, folder)
    os.rename(f"{folder}/yil=2000", f"{folder}/_old-2000-x")
    assert rows_by_period(spark, folder) == before
    assert kpis(load_periods(spark, folder, P))[0] is not None
    assert recover_periods(spark, folder) == [2000] and recover_periods(spark, folder) == []
    assert rows_by_period(spark, folder) == before and hidden(folder) == []
    for y in (1999, 2000):
        os.rename(f"{folder}/yil={y}", f"{folder}/_old-{y}-x")
    assert rows_by_period(spark, folder) == before
    replace_period(plus_one(spark, folder, 2000), folder, 2000)
    n, adet = before[2000]
    assert rows_by_period(spark, folder) == {1999: before[1999], 2000: (n, adet + n)}
    assert hidden(folder) == ["_old-1999-x"] and recover_periods(spark, folder) == [1999]


def test_readers_see_the_period_between_the_renames(spark, folder, monkeypatch):
    before, rename, seen = rows_by_period(spark, folder), periods._rename, []

    def watched(fs, source, target):
        seen.append(rows_by_period(spark, folder))
        rename(fs, source, target)
        if len(seen) == 1:
            assert not os.path.exists(f"{folder}/yil=2000")
    monkeypatch.setattr(periods, "_rename", watched)
    replace_period(plus_one(spark, folder, 2000), folder, 2000)
    assert seen == [before, before]


def test_leftovers_of_a_finished_swap_go(spark, folder):
    before = rows_by_period(spark, folder)
    os.makedirs(f"{folder}/_old-2000-x")
    assert rows_by_period(spark, folder) == before and recover_periods(spark, folder) == []
    replace_period(plus_one(spark, folder, 2000), folder, 2000)
    assert hidden(folder) == []
