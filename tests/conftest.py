import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from periodlens.schema import FACT_SCHEMA  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    b = (SparkSession.builder.master("local[*]").appName("periodlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Tests set their own shared folder only where the session names none.
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="periodlens-test-ckpt-"))
    yield s


DEFAULT_ROW = dict(sm="S1", bs="B1", magaza_kod="M1", magaza_ad="Store 1", nitelik="N1",
                   urun_grubu="UG", ust_mal="UG/A", mal_grubu="UG/A/x", urun_kod="P1",
                   urun_ad="Product 1", yil=2025, adet=0.0, ciro=0.0, marj=0.0, fire=0.0,
                   envanter=0.0, kampanya_zarar=0.0)


@pytest.fixture
def mkfact(spark):
    """Build a fact from partial rows (defaults filled in)."""
    def make(rows):
        full = [tuple({**DEFAULT_ROW, **r}[f.name] for f in FACT_SCHEMA.fields) for r in rows]
        nullable = FACT_SCHEMA.__class__([f.__class__(f.name, f.dataType, True)
                                          for f in FACT_SCHEMA.fields])
        return spark.createDataFrame(full, schema=nullable)
    return make
