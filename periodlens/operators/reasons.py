"""Rule-based reasons attached to result rows (RSN-1, RSN-2, SCL-5).

Both are row-local Column expressions (no shuffle, no Python): RSN-1 is one
``when`` chain; RSN-2 builds an array of candidate structs, drops the unmet
ones, sorts by priority and keeps the first two.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import nz, pct_change
from ..functions.text import pct, thousands

# Fixed values (RSN-1): reason, action and colour of the seven performance
# rules, in rule order. The texts of rules 5 and 6 are our own wording; the others
# equal the reference's.
PERFORMANCE_TEXTS = (
    ("🔥 Fire artışı kritik", "SKT kontrolü, sipariş azalt", "red"),
    ("📦 Bulunurluk problemi", "Raf yerleşimi ve stok kontrol", "yellow"),
    ("⚠️ Stok/SKT sorunu", "Sipariş miktarını düşür", "red"),
    ("💰 Marj erimesi", "Fiyatlama ve SMM kontrol", "yellow"),
    ("✅ Başarılı sonuç", "Başarı faktörlerini analiz et", "green"),
    ("📉 Adet düşüşü", "Detaylı analiz gerekli", "yellow"),
    ("📊 Normal", "-", "green"),
)

# Fixed values (RSN-2): margin-loss causes in rule order, the default record,
# and the captions used in their explanation texts.
MARGIN_TEXTS = (
    "📉 Satış Düşüşü + Kampanya Artışı",
    "📉 Satış Düşüşü",
    "📦 Envanter Artışı",
    "🔥 Fire Artışı",
    "🏷️ Kampanya Zararı Artışı",
)
MARGIN_DEFAULT = ("📊 Belirgin neden yok", "Detaylı analiz gerekli")
CAPTION_SALES = "Satış"
CAPTION_CAMPAIGN_LOSS = "Kampanya Zararı"
CAPTION_INVENTORY = "Envanter"
CAPTION_WASTE = "Fire"
CAPTION_CAMPAIGN = "Kampanya"
CURRENCY = "₺"
ARROW = " → "


@dataclass(frozen=True)
class ReasonThresholds:
    """RSN-1 thresholds (percent changes); all comparisons are strict."""

    fire_critical: float = 50.0   # rule 1: fire_deg above
    adet_drop: float = -15.0      # rule 2: adet_deg below, with fire_deg below fire_low
    fire_low: float = 20.0
    adet_drop_stock: float = -10.0  # rule 3: adet_deg below, with fire_deg above fire_high
    fire_high: float = 30.0
    marj_drop: float = -20.0      # rule 4: marj_deg below
    adet_rise: float = 20.0       # rule 5: adet_deg above
    adet_fall: float = 0.0        # rule 6: adet_deg below


def _in(df: DataFrame, name: str) -> Column:
    """A missing input column or a null value counts as 0."""
    return nz(name) if name in df.columns else F.lit(0.0)


def _in_sql(df: DataFrame, name: str) -> str:
    return f"coalesce(`{name}`, 0D)" if name in df.columns else "0D"


def reason_rule(df: DataFrame, t: ReasonThresholds = ReasonThresholds()) -> Column:
    """RSN-1 rule number (1..7), first match wins. One CASE expression with
    the thresholds as numeric constants."""
    marj, adet, fire = (_in_sql(df, c) for c in ("marj_deg", "adet_deg", "fire_deg"))
    v = {k: repr(float(x)) + "D" for k, x in vars(t).items()}
    return F.expr(
        f"CASE WHEN {fire} > {v['fire_critical']} THEN 1"
        f" WHEN {adet} < {v['adet_drop']} AND {fire} < {v['fire_low']} THEN 2"
        f" WHEN {adet} < {v['adet_drop_stock']} AND {fire} > {v['fire_high']} THEN 3"
        f" WHEN {marj} < {v['marj_drop']} THEN 4"
        f" WHEN {adet} > {v['adet_rise']} THEN 5"
        f" WHEN {adet} < {v['adet_fall']} THEN 6"
        f" ELSE 7 END")


def with_reason(df: DataFrame, t: ReasonThresholds = ReasonThresholds()) -> DataFrame:
    """Adds ``neden_kod``, ``neden``, ``aksiyon``, ``renk`` in one projection
    (the rule is a common subexpression, evaluated once per row)."""
    arrays = [F.array(*[F.lit(row[i]) for row in PERFORMANCE_TEXTS]) for i in range(3)]
    kod = reason_rule(df, t)
    return df.select("*", kod.alias("neden_kod"),
                     *[F.element_at(a, kod).alias(n)
                       for a, n in zip(arrays, ("neden", "aksiyon", "renk"))])


def _money(x: Column) -> Column:
    return F.concat(F.lit(CURRENCY), thousands(x))


def _change(caption: str, old: Column, new: Column, fmt) -> Column:
    return F.concat(F.lit(caption + ": "), fmt(old), F.lit(ARROW), fmt(new))


def margin_reason_array(df: DataFrame, keep: int | None = None) -> Column:
    """RSN-2 as ``array<struct<kural, neden, aciklama, oncelik>>``: every cause
    that holds, priority descending, rule order among equal priorities, the
    first ``keep`` of them; no cause becomes one default record without rule
    or priority. Only kept causes get their text."""
    a0, a1 = _in(df, "adet_prev"), _in(df, "adet_cur")
    e0, e1 = _in(df, "envanter_prev"), _in(df, "envanter_cur")
    f0, f1 = F.abs(_in(df, "fire_prev")), F.abs(_in(df, "fire_cur"))
    k0, k1 = F.abs(_in(df, "kampanya_prev")), F.abs(_in(df, "kampanya_cur"))
    af, ef, ff, kf = a1 - a0, e1 - e0, f1 - f0, k1 - k0
    sales = F.concat(_change(CAPTION_SALES, a0, a1, thousands), F.lit(" ("),
                     pct(pct_change(a0, a1, 0.0)), F.lit(")"))
    campaign_tail = F.concat(F.lit(" (+" + CURRENCY), thousands(kf), F.lit(")"))

    def rise(caption, old, new, d):
        return F.concat(_change(caption, old, new, _money), F.lit(" (+" + CURRENCY),
                        thousands(d), F.lit(", "), pct(pct_change(old, new, 100.0)),
                        F.lit(")"))

    arms = [
        ((af < 0) & (kf > 0), F.abs(af) + kf, F.concat(
            sales, F.lit("\n"), _change(CAPTION_CAMPAIGN_LOSS, k0, k1, _money), campaign_tail)),
        ((af < 0) & ~(kf > 0), F.abs(af), sales),
        (ef > 0, ef, rise(CAPTION_INVENTORY, e0, e1, ef)),
        (ff > 0, ff, rise(CAPTION_WASTE, f0, f1, ff)),
        ((kf > 0) & (af >= 0), kf,
         F.concat(_change(CAPTION_CAMPAIGN, k0, k1, _money), campaign_tail)),
    ]
    none = ~(arms[0][0] | arms[1][0] | arms[2][0] | arms[3][0] | arms[4][0])
    # Ascending on (-priority, rule) = priority desc, stable. Rule 0 is the default.
    cands = [F.when(cond, F.struct((-prio).alias("k"), F.lit(i + 1).alias("kural")))
             for i, (cond, prio, _) in enumerate(arms)]
    cands.append(F.when(none, F.struct(F.lit(0.0).alias("k"), F.lit(0).alias("kural"))))
    found = F.sort_array(F.array_compact(F.array(*cands)))
    if keep is not None:
        found = F.slice(found, 1, keep)
    names = F.array(*[F.lit(t) for t in (MARGIN_DEFAULT[0], *MARGIN_TEXTS)])

    def record(s: Column) -> Column:
        rule = s["kural"]
        text = F.lit(MARGIN_DEFAULT[1])
        for i, (_, _, words) in reversed(list(enumerate(arms))):
            text = F.when(rule == i + 1, words).otherwise(text)
        return F.struct(F.when(rule > 0, rule).alias("kural"),
                        F.element_at(names, rule + 1).alias("neden"), text.alias("aciklama"),
                        F.when(rule > 0, -s["k"]).alias("oncelik"))

    return F.transform(found, record)


def margin_reasons(df: DataFrame, keys: Sequence[str], keep: int = 2,
                   losses_only: bool = True) -> DataFrame:
    """RSN-2, flat: one row per key and kept cause, with its rank
    (``neden_sira``). FLT-18: only rows with a margin loss by default."""
    src = df.where(F.col("marj_fark") < 0) if losses_only else df
    return (src.select(*keys, F.posexplode(margin_reason_array(src, keep)).alias("pos", "r"))
               .select(*keys, (F.col("pos") + 1).alias("neden_sira"),
                       F.col("r.kural").alias("kural"), F.col("r.neden").alias("neden"),
                       F.col("r.aciklama").alias("aciklama"),
                       F.col("r.oncelik").alias("oncelik")))
