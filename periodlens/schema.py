"""Sales fact schema, load check (SRC-2) and load-time normalisation.

One row of the fact = one product in one store in one period. Column names
are the lower-case forms of the reference's names (organisation, product
hierarchy, period, six measures).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Organisation: sm -> bs -> magaza_kod (+ magaza_ad label).
# Product: nitelik (free-standing attribute); urun_grubu -> ust_mal -> mal_grubu
# -> urun_kod (+ urun_ad label).
DIMENSIONS = (
    "sm",
    "bs",
    "magaza_kod",
    "magaza_ad",
    "nitelik",
    "urun_grubu",
    "ust_mal",
    "mal_grubu",
    "urun_kod",
    "urun_ad",
)
PERIOD = "yil"
MEASURES = ("adet", "ciro", "marj", "fire", "envanter", "kampanya_zarar")

FACT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in DIMENSIONS]
    + [T.StructField(PERIOD, T.IntegerType(), False)]
    + [T.StructField(m, T.DoubleType(), True) for m in MEASURES]
)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class FactSchemaError(ValueError):
    """The input does not have the columns or types of a sales fact."""


def lower_case_columns(df: DataFrame) -> DataFrame:
    """DRV-7: the reference names columns ``SM``, ``Magaza_Kod``, ``Yil`` ...;
    the library works on their lower-case forms."""
    if all(c == c.lower() for c in df.columns):
        return df
    return df.toDF(*[c.lower() for c in df.columns])


def check_fact(df: DataFrame, require_period: bool = True) -> None:
    """SRC-2: fail with one clear message when columns are missing or of the
    wrong kind. Only the schema is inspected, no job is run."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    wanted = list(DIMENSIONS) + list(MEASURES) + ([PERIOD] if require_period else [])
    missing = [c for c in wanted if c not in fields]
    if missing:
        raise FactSchemaError(f"sales fact is missing columns: {', '.join(missing)}")
    bad = [m for m in MEASURES if not isinstance(fields[m], _NUMERIC)]
    if require_period and not isinstance(fields[PERIOD], _INTEGRAL):
        bad.append(PERIOD)
    if bad:
        raise FactSchemaError(f"sales fact columns not numeric: {', '.join(bad)}")


def _measure(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        # NaN acts as null (the reference's SQL engine sees NaN as null);
        # left alone, Spark would let NaN poison sums and compare NaN > 0 true.
        return F.when(F.isnan(c), F.lit(None)).otherwise(c).alias(name)
    return c.alias(name)


def dim(name: str) -> Column:
    """A dimension as the reference compares it: a string, missing = ''.

    The loaded columns keep their nulls; every operator that groups by,
    labels with or lists a dimension reads it through this expression, and
    predicates compare with non-empty literals (where null and '' behave the
    same), so equality filters stay plain column comparisons that the
    parquet reader can use."""
    return F.expr(f"coalesce(`{name}`, '')")


def normalise(df: DataFrame) -> DataFrame:
    """Canonical column order; dimensions as strings, period as int; NaN
    measures -> null. Decimal measures stay decimal so sums are exact."""
    df = lower_case_columns(df)
    check_fact(df)
    cols = [F.col(c).cast("string").alias(c) for c in DIMENSIONS]
    cols.append(F.col(PERIOD).cast("int").alias(PERIOD))
    cols += [_measure(df, m) for m in MEASURES]
    return df.select(*cols)
