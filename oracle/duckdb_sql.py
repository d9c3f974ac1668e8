"""DuckDB SQL for the correctness oracle: the same analyses written as plain
SQL over the fixture fact ``veri`` (FIXTURES.md §2), built from the
pre-registered TPC-H-like views. Independent of the Spark code path."""

from __future__ import annotations

PREV, CUR = 1999, 2000

FACT_CTE = """veri AS (
  SELECT r_name AS sm, n_name AS bs,
    CAST(l_suppkey AS VARCHAR) AS magaza_kod, s_name AS magaza_ad,
    concat('N', CAST(CAST(floor((p_size - 1) / 10.0) AS INTEGER) + 1 AS VARCHAR)) AS nitelik,
    p_type AS urun_grubu,
    concat(p_type, '/', split_part(p_name, ' ', 2)) AS ust_mal,
    concat(p_type, '/', p_name) AS mal_grubu,
    CAST(l_partkey AS VARCHAR) AS urun_kod, concat(p_name, ' ', p_brand) AS urun_ad,
    CAST(year(l_shipdate) AS INTEGER) AS yil,
    CAST(l_quantity AS DECIMAL(18,2)) AS adet,
    CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS ciro,
    CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
      - 1.5 * CAST(l_quantity AS DECIMAL(10,2)) * CAST(p_retailprice AS DECIMAL(10,2)) AS marj,
    CASE WHEN l_returnflag = 'R'
         THEN -CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))
         ELSE 0 END AS fire,
    CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * 0.10
         ELSE -CAST(l_extendedprice AS DECIMAL(18,2)) * 0.05 END AS envanter,
    -CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS kampanya_zarar
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00'
    AND l_shipdate < TIMESTAMP '2001-01-01 00:00:00'
)"""

SRC = {"adet": "adet", "ciro": "ciro", "marj": "marj", "fire": "ABS(fire)",
       "envanter": "ABS(envanter)", "kampanya": "ABS(kampanya_zarar)"}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_fact(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([FACT_CTE, *ctes]) + "\n" + body


def where_sql(conds) -> str:
    conds = [f"yil IN ({PREV}, {CUR})", *conds]
    return " AND ".join(conds)


def sel_eq(**kv) -> list[str]:
    return [f"{k} = {q(v)}" for k, v in kv.items()]


def two_period(keys, labels, measures, cur_only=(), conds=()) -> str:
    cols = list(keys) + [f"MAX({l}) AS {l}" for l in labels]
    for m in measures:
        cols.append(f"CAST(SUM(CASE WHEN yil = {PREV} THEN {SRC[m]} ELSE 0 END) AS DOUBLE) AS {m}_prev")
        cols.append(f"CAST(SUM(CASE WHEN yil = {CUR} THEN {SRC[m]} ELSE 0 END) AS DOUBLE) AS {m}_cur")
    for m in cur_only:
        cols.append(f"CAST(SUM(CASE WHEN yil = {CUR} THEN {SRC[m]} ELSE 0 END) AS DOUBLE) AS {m}_cur")
    return (f"SELECT {', '.join(cols)} FROM veri WHERE {where_sql(conds)} "
            f"GROUP BY {', '.join(keys)}")


def deg(m: str, no_base: float = 0.0, name: str | None = None) -> str:
    return (f"CASE WHEN {m}_prev > 0 THEN ({m}_cur / {m}_prev - 1) * 100 "
            f"ELSE CAST({no_base} AS DOUBLE) END AS {name or m + '_deg'}")


def ratio(num: str, den: str, name: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} * 100 ELSE CAST(0 AS DOUBLE) END AS {name}"


def margin_cols(oran_fark: bool) -> list[str]:
    cols = ["marj_cur - marj_prev AS marj_fark", deg("marj"),
            ratio("marj_prev", "ciro_prev", "marj_oran_prev"),
            ratio("marj_cur", "ciro_cur", "marj_oran_cur")]
    return cols


def derive(inner: str, extra: list[str], post_where=(), oran_fark=False) -> str:
    w = f" WHERE {' AND '.join(post_where)}" if post_where else ""
    s = f"SELECT *, {', '.join(extra)} FROM ({inner}) t{w}" if extra else f"SELECT * FROM ({inner}) t{w}"
    if oran_fark:
        s = f"SELECT *, marj_oran_cur - marj_oran_prev AS marj_oran_fark FROM ({s}) u"
    return s


def order(by: str, largest: bool, tie: str) -> str:
    return f"{by} {'DESC' if largest else 'ASC'} NULLS LAST, {tie} ASC"


def top(inner: str, by: str, n: int, largest: bool, tie: str) -> str:
    return f"SELECT * FROM ({inner}) x ORDER BY {order(by, largest, tie)} LIMIT {n}"


def top_per_parent(inner: str, parent: str, by: str, n: int, largest: bool, tie: str) -> str:
    return (f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {parent} "
            f"ORDER BY {order(by, largest, tie)}) AS INTEGER) AS sira FROM ({inner}) x) y "
            f"WHERE sira <= {n}")


# --- analyses ------------------------------------------------------------------

BASIC = ("adet", "ciro", "marj", "fire")
MARGIN = ("marj", "ciro", "adet", "fire", "envanter", "kampanya")


def analysis(name: str, conds=(), min_ciro: float = 10000.0, min_adet: float = 0) -> str:
    """Q-2, 4, 8, 11, 13, 19, 20 (the fact CTE is added by the caller)."""
    if name == "mal_grubu":
        inner = two_period(["mal_grubu"], ["ust_mal"], BASIC, conds=[*conds, "mal_grubu <> ''"])
        post = [f"ciro_cur >= {min_ciro / 1.0}"] if min_ciro > 0 else []
        return derive(inner, [deg(m) for m in BASIC], post)
    if name == "urun_grubu":
        inner = two_period(["urun_grubu"], [], BASIC, conds=[*conds, "urun_grubu <> ''"])
        post = [f"ciro_cur >= {min_ciro / 1.0}"] if min_ciro > 0 else []
        return derive(inner, [deg(m) for m in BASIC], post)
    if name == "urun":
        inner = two_period(["urun_kod"], ["urun_ad", "mal_grubu", "ust_mal", "urun_grubu"],
                           BASIC, conds=[*conds, "urun_kod <> ''"])
        post = [f"ciro_cur >= {min_ciro / 5.0}"] if min_ciro > 0 else []
        return derive(inner, [deg(m) for m in BASIC], post)
    if name == "urun_adet":
        inner = two_period(["urun_kod"], ["urun_ad", "mal_grubu", "urun_grubu"],
                           ("adet", "ciro", "marj"), conds=[*conds, "urun_kod <> ''"])
        post = [f"adet_cur >= {float(min_adet)}"] if min_adet > 0 else []
        return derive(inner, [deg("adet"), deg("ciro")], post)
    if name == "urun_ciro":
        inner = two_period(["urun_kod"], ["urun_ad", "mal_grubu", "urun_grubu"],
                           ("adet", "ciro", "marj"), conds=[*conds, "urun_kod <> ''"])
        return derive(inner, [deg("adet"), deg("ciro")], ["ciro_cur > 0"])
    if name == "marj_mal_grubu":
        inner = two_period(["mal_grubu"], ["ust_mal"], MARGIN, conds=[*conds, "mal_grubu <> ''"])
        post = [f"ciro_cur >= {min_ciro / 1.0}"] if min_ciro > 0 else []
        return derive(inner, margin_cols(True), post, oran_fark=True)
    if name == "marj_urun":
        inner = two_period(["urun_kod"], ["urun_ad", "mal_grubu"], MARGIN,
                           conds=[*conds, "urun_kod <> ''"])
        post = [f"ciro_cur >= {min_ciro / 10.0}"] if min_ciro > 0 else []
        return derive(inner, margin_cols(False), post)
    raise KeyError(name)


# Reason texts (RSN-1 / RSN-2), as operators/reasons.py words them.
RSN1 = [
    ("🔥 Fire artışı kritik", "SKT kontrolü, sipariş azalt", "red"),
    ("📦 Bulunurluk problemi", "Raf yerleşimi ve stok kontrol", "yellow"),
    ("⚠️ Stok/SKT sorunu", "Sipariş miktarını düşür", "red"),
    ("💰 Marj erimesi", "Fiyatlama ve SMM kontrol", "yellow"),
    ("✅ Başarılı sonuç", "Başarı faktörlerini analiz et", "green"),
    ("📉 Adet düşüşü", "Detaylı analiz gerekli", "yellow"),
    ("📊 Normal", "-", "green"),
]
RSN2 = [
    "📉 Satış Düşüşü + Kampanya Artışı",
    "📉 Satış Düşüşü",
    "📦 Envanter Artışı",
    "🔥 Fire Artışı",
    "🏷️ Kampanya Zararı Artışı",
]
RSN2_DEFAULT = ("📊 Belirgin neden yok", "Detaylı analiz gerekli")


def with_reason(inner: str) -> str:
    m, a, f = ("COALESCE(marj_deg, 0)", "COALESCE(adet_deg, 0)", "COALESCE(fire_deg, 0)")
    kod = (f"CASE WHEN {f} > 50 THEN 1 WHEN {a} < -15 AND {f} < 20 THEN 2 "
           f"WHEN {a} < -10 AND {f} > 30 THEN 3 WHEN {m} < -20 THEN 4 "
           f"WHEN {a} > 20 THEN 5 WHEN {a} < 0 THEN 6 ELSE 7 END")
    def pick(i):
        return "CASE neden_kod " + " ".join(
            f"WHEN {k + 1} THEN {q(r[i])}" for k, r in enumerate(RSN1)) + " END"
    return (f"SELECT *, {pick(0)} AS neden, {pick(1)} AS aksiyon, {pick(2)} AS renk FROM "
            f"(SELECT *, {kod} AS neden_kod FROM ({inner}) r0) r1")


def margin_reasons(inner: str, key: str) -> str:
    """RSN-2 flat: loss rows only, two strongest causes, default record."""
    th = lambda x: f"printf('%,.0f', {x})"
    pc = lambda x: f"printf('%+.1f', {x}) || '%'"
    loss = (f"SELECT {key}, COALESCE(adet_prev, 0) a0, COALESCE(adet_cur, 0) a1, "
            f"COALESCE(envanter_prev, 0) e0, COALESCE(envanter_cur, 0) e1, "
            f"ABS(COALESCE(fire_prev, 0)) f0, ABS(COALESCE(fire_cur, 0)) f1, "
            f"ABS(COALESCE(kampanya_prev, 0)) k0, ABS(COALESCE(kampanya_cur, 0)) k1 "
            f"FROM ({inner}) b WHERE marj_fark < 0")
    d = ("SELECT *, a1 - a0 af, e1 - e0 ef, f1 - f0 ff, k1 - k0 kf, "
         "CASE WHEN a0 > 0 THEN (a1 / a0 - 1) * 100 ELSE CAST(0 AS DOUBLE) END adeg, "
         "CASE WHEN e0 > 0 THEN (e1 / e0 - 1) * 100 ELSE CAST(100 AS DOUBLE) END edeg, "
         "CASE WHEN f0 > 0 THEN (f1 / f0 - 1) * 100 ELSE CAST(100 AS DOUBLE) END fdeg "
         "FROM loss")
    sales = f"'Satış: ' || {th('a0')} || ' → ' || {th('a1')} || ' (' || {pc('adeg')} || ')'"
    camp = (f"'Kampanya Zararı: ₺' || {th('k0')} || ' → ₺' || {th('k1')} "
            f"|| ' (+₺' || {th('kf')} || ')'")
    inv = (f"'Envanter: ₺' || {th('e0')} || ' → ₺' || {th('e1')} || ' (+₺' || {th('ef')} "
           f"|| ', ' || {pc('edeg')} || ')'")
    waste = (f"'Fire: ₺' || {th('f0')} || ' → ₺' || {th('f1')} || ' (+₺' || {th('ff')} "
             f"|| ', ' || {pc('fdeg')} || ')'")
    camp2 = (f"'Kampanya: ₺' || {th('k0')} || ' → ₺' || {th('k1')} "
             f"|| ' (+₺' || {th('kf')} || ')'")
    arms = [
        ("af < 0 AND kf > 0", f"{sales} || chr(10) || {camp}", "ABS(af) + kf"),
        ("af < 0 AND NOT (kf > 0)", sales, "ABS(af)"),
        ("ef > 0", inv, "ef"),
        ("ff > 0", waste, "ff"),
        ("kf > 0 AND af >= 0", camp2, "kf"),
    ]
    cand = " UNION ALL ".join(
        f"SELECT {key}, {i + 1} AS kural, {q(RSN2[i])} AS neden, {text} AS aciklama, "
        f"CAST({prio} AS DOUBLE) AS oncelik FROM d WHERE {cond}"
        for i, (cond, text, prio) in enumerate(arms))
    return (f"loss AS ({loss}), d AS ({d}), cand AS ({cand}), "
            f"ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} "
            f"ORDER BY oncelik DESC, kural ASC) AS INTEGER) AS neden_sira FROM cand)",
            f"SELECT {key}, neden_sira, kural, neden, aciklama, oncelik FROM ranked "
            f"WHERE neden_sira <= 2 UNION ALL "
            f"SELECT {key}, CAST(1 AS INTEGER) AS neden_sira, CAST(NULL AS INTEGER) AS kural, "
            f"{q(RSN2_DEFAULT[0])} AS neden, {q(RSN2_DEFAULT[1])} AS aciklama, "
            f"CAST(NULL AS DOUBLE) AS oncelik FROM d "
            f"WHERE {key} NOT IN (SELECT {key} FROM cand)")


# --- KPIs --------------------------------------------------------------------

def kpi_summary(conds=()) -> str:
    cols = []
    for m in BASIC:
        for tag, y in (("prev", PREV), ("cur", CUR)):
            cols.append(f"COALESCE(CAST(SUM(CASE WHEN yil = {y} THEN {SRC[m]} END) AS DOUBLE), "
                        f"CAST(0 AS DOUBLE)) AS {m}_{tag}")
    inner = f"SELECT {', '.join(cols)} FROM veri WHERE {where_sql(conds)}"
    return derive(inner, [deg(m, name=f"{m}_degisim") for m in BASIC])


def kpi_trend(conds=()) -> str:
    inverse = {"adet": False, "ciro": False, "marj": False, "fire": True}
    parts = []
    for i, m in enumerate(BASIC):
        yon = (f"CASE WHEN ({m}_degisim > 0) = {str(inverse[m]).upper()} THEN 'down' "
               f"ELSE 'up' END")
        value = (f"printf('%,.0f', {m}_cur)" if m == "adet"
                 else f"'₺' || printf('%,.0f', {m}_cur)")
        change = (f"CASE WHEN {m}_degisim > 0 THEN '+' ELSE '' END || "
                  f"printf('%.1f', {m}_degisim) || '%'")
        parts.append(f"SELECT {i + 1} AS sira, {q(m)} AS metrik, {m}_cur AS deger, "
                     f"{m}_degisim AS degisim, {yon} AS yon, {value} AS deger_metin, "
                     f"{change} AS degisim_metin FROM s")
    return "s AS (" + kpi_summary(conds) + ")", " UNION ALL ".join(parts)


def margin_kpi(conds=()) -> str:
    cols = []
    for m in ("marj", "ciro"):
        for tag, y in (("prev", PREV), ("cur", CUR)):
            cols.append(f"COALESCE(CAST(SUM(CASE WHEN yil = {y} THEN {SRC[m]} END) AS DOUBLE), "
                        f"CAST(0 AS DOUBLE)) AS {m}_{tag}")
    inner = f"SELECT {', '.join(cols)} FROM veri WHERE {where_sql(conds)}"
    return derive(inner, margin_cols(True), oran_fark=True)


# --- drill-downs -----------------------------------------------------------------

STORE_LABELS = ["magaza_ad", "bs"]


def drill(parent: str, child: str, labels, measures, cur_only=(), key: str | None = None,
          having=(), extra=(), conds=(), child_non_empty=False, order_by="adet_cur",
          largest=True, n: int | None = None, positive_only=False) -> str:
    c = list(conds)
    c.append(f"{parent} = {q(key)}" if key is not None else f"{parent} <> ''")
    if child_non_empty:
        c.append(f"{child} <> ''")
    inner = two_period([parent, child], labels, measures, cur_only, c)
    post = list(having)
    inner = derive(inner, list(extra), post)
    if positive_only:
        inner = f"SELECT * FROM ({inner}) p WHERE {order_by} > 0"
    if n is None:
        return inner
    if key is not None:
        return top(inner, order_by, n, largest, child)
    return top_per_parent(inner, parent, order_by, n, largest, child)


def falling(parent: str, key: str | None, n: int = 5, conds=()) -> str:
    ms = ("adet", "ciro", "marj") if parent == "mal_grubu" else ("adet", "ciro")
    return drill(parent, "magaza_kod", STORE_LABELS, ms, ("fire",), key,
                 having=["adet_prev > 0"],
                 extra=["adet_cur - adet_prev AS adet_fark", deg("adet"), deg("ciro")],
                 conds=conds, order_by="adet_fark", largest=False, n=n)


def rising(parent: str, key: str | None, n: int = 5, conds=()) -> str:
    ms = ("adet", "ciro", "marj") if parent == "mal_grubu" else ("adet", "ciro")
    return drill(parent, "magaza_kod", STORE_LABELS, ms, ("fire",), key,
                 having=["(adet_prev > 0 OR adet_cur > 0)"],
                 extra=["adet_cur - adet_prev AS adet_fark", deg("adet", 100.0),
                        deg("ciro", 100.0)],
                 conds=conds, order_by="adet_fark", largest=True, n=n)


# --- reports ---------------------------------------------------------------------

def _reasoned(inner: str) -> str:
    return f"SELECT * EXCLUDE (neden_kod, renk) FROM ({with_reason(inner)}) w"


# report -> tables (name -> (sql, key)), sheets (name, table, by, n, largest, positive)
def reports(conds=()) -> dict:
    return {
        "mal_grubu": ({"main": (_reasoned(analysis("mal_grubu", conds)), "mal_grubu")},
                      [("En Kötü 20", "main", "adet_deg", 20, False, False),
                       ("En İyi 20", "main", "adet_deg", 20, True, False),
                       ("Tüm Veriler", "main", None, None, None, False)]),
        "urun_grubu": ({"main": (_reasoned(analysis("urun_grubu", conds)), "urun_grubu")},
                       [("En Kötü 20", "main", "adet_deg", 20, False, False),
                        ("En İyi 20", "main", "adet_deg", 20, True, False),
                        ("Tüm Veriler", "main", None, None, None, False)]),
        "urun": ({"main": (_reasoned(analysis("urun", conds)), "urun_kod")},
                 [("En Kötü 50", "main", "adet_deg", 50, False, False),
                  ("En İyi 50", "main", "adet_deg", 50, True, False),
                  ("Tüm Veriler", "main", None, None, None, False)]),
        "adet": ({"main": (analysis("urun_adet", conds), "urun_kod")},
                 [("En Çok Satan 50", "main", "adet_cur", 50, True, False),
                  ("En Az Satan 50", "main", "adet_cur", 50, False, True),
                  ("Tüm Veriler", "main", None, None, None, False)]),
        "ciro": ({"main": (analysis("urun_ciro", conds), "urun_kod")},
                 [("En Çok Ciro 50", "main", "ciro_cur", 50, True, False),
                  ("En Az Ciro 50", "main", "ciro_cur", 50, False, False),
                  ("Tüm Veriler", "main", None, None, None, False)]),
        "marj": ({"main": (analysis("marj_mal_grubu", conds), "mal_grubu"),
                  "urun": (analysis("marj_urun", conds), "urun_kod")},
                 [("Mal Grubu - Kayıp", "main", "marj_fark", 20, False, False),
                  ("Mal Grubu - Kazanç", "main", "marj_fark", 20, True, False),
                  ("Mal Grubu - Tümü", "main", None, None, None, False),
                  ("Malzeme - Kayıp", "urun", "marj_fark", 20, False, False),
                  ("Malzeme - Kazanç", "urun", "marj_fark", 20, True, False)]),
    }


def report(name: str, conds=()) -> str:
    tables, sheets = reports(conds)[name]
    parts = []
    for sheet, table, by, n, largest, positive in sheets:
        sql, key = tables[table]
        if positive:
            sql = f"SELECT * FROM ({sql}) p WHERE {by} > 0"
        if by is not None:
            sql = top(sql, by, n, largest, key)
        parts.append(f"SELECT {q(sheet)} AS sayfa, * FROM ({sql}) s")
    return "(" + ") UNION ALL BY NAME (".join(parts) + ")"
