"""Text expressions (SCL-3..10).

``format_number`` rounds half-even on the binary value, as Python's
``{:,.0f}`` does; ``format_string('%.1f')`` would round half-up, so it is
not used.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sign(x: Column) -> Column:
    return F.when(x >= 0, F.lit("+")).otherwise(F.lit(""))


def thousands(x) -> Column:
    """SCL-3 ``{:,.0f}``."""
    return F.format_number(_c(x), 0)


def signed_thousands(x) -> Column:
    """SCL-3 ``{:+,.0f}``."""
    x = _c(x)
    return F.concat(_sign(x), F.format_number(x, 0))


def fixed(x, decimals: int = 1) -> Column:
    """``{:.Nf}``: like ``format_number`` without grouping commas."""
    return F.regexp_replace(F.format_number(_c(x), decimals), ",", "")


def signed_fixed(x, decimals: int = 1) -> Column:
    """``{:+.Nf}``."""
    x = _c(x)
    return F.concat(_sign(x), fixed(x, decimals))


def pct(x, decimals: int = 1, signed: bool = True) -> Column:
    """SCL-4 percent text: ``{:+.1f}%`` / ``{:.1f}%`` / ``{:+.2f}%``."""
    body = signed_fixed(x, decimals) if signed else fixed(x, decimals)
    return F.concat(body, F.lit("%"))


def short_label(x, n: int) -> Column:
    """SCL-6: over n characters -> first n + '...'."""
    x = _c(x)
    return (F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("...")))
            .otherwise(x))


def heading_label(x, n: int = 30) -> Column:
    """SCL-6 heading form: always cut at n and add '...'."""
    return F.concat(F.substring(_c(x), 1, n), F.lit("..."))


def option_label(code, name) -> Column:
    """OPT-10 / SCL-8: ``"kod - ad"``."""
    return F.concat_ws(" - ", _c(code), _c(name))


def code_from_label(label) -> Column:
    """OPT-10 / SCL-8: the code back from ``"kod - ad"`` (text before the
    first ``' - '``, as the reference does)."""
    return F.substring_index(_c(label), " - ", 1)


def timestamp_text(ts: dt.datetime | None = None) -> Column:
    """SCL-9 ``%Y-%m-%d %H:%M``; ``ts`` injectable for tests."""
    c = F.current_timestamp() if ts is None else F.lit(ts)
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def money(x) -> Column:
    """SCL-3 with the currency prefix: ``₺{:,.0f}``."""
    return F.concat(F.lit("₺"), thousands(x))
