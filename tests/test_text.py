"""Text expressions against Python's own formatting (SCL-3..10)."""

import datetime as dt

from periodlens.functions import (code_from_label, fixed, heading_label, money, option_label,
                                  pct, short_label, signed_thousands, thousands,
                                  timestamp_text)

VALUES = [0.0, 0.4, -0.4, 0.5, 1.5, 2.5, -2.5, 0.25, 0.15, 0.05, 1234.5, 1234567.5,
          -1234.5, 999.95, 12.345, -0.04, 100.0, 2900.0, 1e9 + 0.5, 0.125, -60.00000000000001]


def test_number_formats_match_python(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    out = df.select("x", thousands("x").alias("a"), signed_thousands("x").alias("b"),
                    fixed("x", 1).alias("c"), pct("x").alias("d"),
                    pct("x", 2).alias("e"), pct("x", signed=False).alias("f"),
                    money("x").alias("g")).collect()
    for r in out:
        x = r.x
        assert r.a == f"{x:,.0f}", x
        assert r.b == f"{x:+,.0f}", x
        assert r.c == f"{x:.1f}", x
        assert r.d == f"{x:+.1f}%", x
        assert r.e == f"{x:+.2f}%", x
        assert r.f == f"{x:.1f}%", x
        assert r.g == f"₺{x:,.0f}", x


def test_labels(spark):
    names = ["short", "x" * 40, "y" * 41, "çğıöşü" * 10, ""]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    out = df.select("s", short_label("s", 40).alias("k"), heading_label("s").alias("h"))
    for r in out.collect():
        s = r.s
        assert r.k == (s[:40] + "..." if len(s) > 40 else s)
        assert r.h == s[:30] + "..."


def test_option_label_round_trip(spark):
    df = spark.createDataFrame([("12", "Store - East"), ("7", "X")], "k string, a string")
    out = df.select(option_label("k", "a").alias("lab")).select(
        "lab", code_from_label("lab").alias("code")).collect()
    assert [(r.lab, r.code) for r in out] == [("12 - Store - East", "12"), ("7 - X", "7")]


def test_timestamp_text(spark):
    ts = dt.datetime(2025, 11, 3, 14, 5, 59)
    assert spark.range(1).select(timestamp_text(ts).alias("t")).first().t == "2025-11-03 14:05"
