"""The command-line page run on period files in the reference's layout."""

from pyspark.sql import functions as F

from periodlens import Periods
from periodlens.__main__ import main
from periodlens.sources import fixture_fact

from .conftest import SF_SMALL
from .test_sources import REF_NAMES


def test_cli_page_reports_drilldowns(spark, tmp_path):
    fact = fixture_fact(spark, SF_SMALL, Periods(1999, 2000))
    args = []
    for y in (1999, 2000):
        p = str(tmp_path / f"veri_{y}.parquet")
        (fact.where(F.col("yil") == y).drop("yil")
             .select(*[F.col(c).alias(REF_NAMES[c]) for c in REF_NAMES]).write.parquet(p))
        args += ["--period-file", f"{y}={p}"]
    out = str(tmp_path / "out")
    done = main(args + ["--out", out, "--sm", "ASIA", "--min-ciro", "0",
                        "--fact-out", str(tmp_path / "fact")], spark=spark)
    assert spark.read.parquet(str(tmp_path / "fact")).count() == fact.count()
    assert set(done) == {"page", "reports", "drilldown"}
    assert len(done["page"]) == 9 and len(done["reports"]) == 6
    g = spark.read.parquet(done["page"]["mal_grubu"])
    assert g.count() > 0 and "neden" in g.columns
    k = spark.read.parquet(done["page"]["ozet"]).first()
    assert k.adet_cur > 0
    st = spark.read.parquet(done["drilldown"]["stores_falling_by_mal_grubu"])
    assert st.groupBy("mal_grubu").count().agg(F.max("count")).first()[0] <= 5


def test_cli_reads_the_fact_four_times(spark, tmp_path, monkeypatch):
    """The product base and one base per parent of the store lists: everything else is
    taken from those."""
    import periodlens.__main__ as cli
    fact = fixture_fact(spark, SF_SMALL, Periods(1999, 2000))
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    seen = fact.coalesce(1).mapInArrow(counted, fact.schema)
    monkeypatch.setattr(cli, "load_periods", lambda *a: seen)
    out = str(tmp_path / "out")
    done = main(["--fact", "unused", "--prev", "1999", "--cur", "2000", "--out", out],
                spark=spark)
    assert passes.value == 4
    assert len(done["drilldown"]) == 16 and len(done["reports"]) == 6
    from periodlens.plans import drilldown as D
    want = D.named("stores_top_margin", fact, Periods(1999, 2000))
    got = spark.read.parquet(done["drilldown"]["stores_top_margin"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
