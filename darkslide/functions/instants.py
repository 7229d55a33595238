"""Instants out of times written in many notations, precisions and zones.

All notations are one regular expression: an alternation with a named group for
each component, numbered by notation. A text is matched once; components are
checked against the calendar and put together by integer arithmetic over days,
for a whole batch at a time. Only named zones need the zone database.

A time that a zone's clock shows twice is the earlier instant; one that it skips
is read with the offset before the change.
"""

from __future__ import annotations

import re
from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Month names, and zone abbreviations with their usual European,
# North American or Japanese meaning in minutes east of Greenwich.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600, "JST": 540,
}

_CLOCK = r"(?P<h{i}>\d{{1,2}}):(?P<mi{i}>\d{{2}})(?::(?P<s{i}>\d{{2}})(?:[.,](?P<f{i}>\d+))?)?"
_HALF = r"(?:\s*(?P<ap{i}>[AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"(?:\s*(?:(?P<off{i}>[+-]\d{{2}}(?::?\d{{2}})?)|\[(?P<br{i}>[A-Za-z_/+\-0-9]+)\]|(?P<nm{i}>[A-Za-z][A-Za-z_]*(?:/[A-Za-z_+\-0-9]+)*)))?"
_MONTH = "|".join(MONTHS)
#: Notations in order of trial; {i} numbers the groups of each.
_NOTATIONS = (
    r"(?P<y{i}>\d{{4}})(?P<sep{i}>[-:/.])(?P<mo{i}>\d{{1,2}})(?P=sep{i})(?P<d{i}>\d{{1,2}})(?:(?:\s+|[Tt])" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?P<y{i}>\d{{4}})(?P<mo{i}>\d{{2}})(?P<d{i}>\d{{2}})[ _Tt-](?P<h{i}>\d{{2}})(?P<mi{i}>\d{{2}})(?:(?P<s{i}>\d{{2}})(?:[.,](?P<f{i}>\d+))?)?" + _ZONE,
    r"(?P<d{i}>\d{{1,2}})\.(?P<mo{i}>\d{{1,2}})\.(?P<y{i}>\d{{4}})(?:,?(?:\s+|[Tt])" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?P<mo{i}>\d{{1,2}})/(?P<d{i}>\d{{1,2}})/(?P<y{i}>\d{{4}})(?:,?(?:\s+|[Tt])" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?:[A-Za-z]{{3,9}}\.?,?\s+)?(?P<d{i}>\d{{1,2}})[\s-]+(?P<mn{i}>" + _MONTH + r")[a-z]*\.?,?[\s-]+(?P<y{i}>\d{{4}})(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?:[A-Za-z]{{3,9}}\.?,?\s+)?(?P<mn{i}>" + _MONTH + r")[a-z]*\.?\s+(?P<d{i}>\d{{1,2}}),?\s+(?P<y{i}>\d{{4}})(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?",
    r"(?P<num{i}>\d+)(?:[.,](?P<f{i}>\d+))?",
)
ALTERNATION = re.compile("(?:" + "|".join(f"(?P<n{i}>{n.format(i=i)})" for i, n in enumerate(_NOTATIONS)) + r")\Z", re.I | re.ASCII)
_FIELDS = ("y", "mo", "mn", "d", "h", "mi", "s", "f", "ap", "off", "br", "nm", "num")
_INDEX = [
    tuple(ALTERNATION.groupindex.get(f"{field}{i}", 0) for field in _FIELDS) for i in range(len(_NOTATIONS))
]
_STARTS = [(ALTERNATION.groupindex[f"n{i}"], _INDEX[i]) for i in range(len(_NOTATIONS))]
_BLANK = " \t\r\n\f\v\0 　"
_UTC_YEARS = (1, 9999)


def _zone(name: str | None) -> ZoneInfo | None:
    if not name:
        return None
    if name not in _zones:
        try:
            _zones[name] = ZoneInfo(name)
        except Exception:  # no such zone, or a name that is no zone name at all
            _zones[name] = None
    return _zones[name]


_zones: dict[str, ZoneInfo | None] = {}


def _offset_minutes(text: str | None) -> int | None:
    """Minutes of +HH, +HHMM, +HH:MM or an abbreviation; None if it is none of them."""
    t = (text or "").strip(_BLANK)
    if re.fullmatch(r"[+-]\d{2}(:?\d{2})?", t, re.ASCII):
        m = int(t[1:3]) * 60 + int(t[-2:] if len(t) > 3 else 0)
        if int(t[1:3]) > 18 or (len(t) > 3 and int(t[-2:]) > 59):
            return None
        return -m if t[0] == "-" else m
    return ABBREVIATIONS.get(t.upper())


def components(text: str | None) -> tuple | None:
    """(year, month, day, hour, minute, second, fraction digits or None, zone) or ("epoch", us); None if unreadable.

    zone is minutes, a ZoneInfo, or None if the text has none. Null, blank and
    texts of any other form are unreadable.
    """
    if text is None:
        return None
    m = ALTERNATION.match(text.strip(_BLANK))
    if not m:
        return None
    at = next(ix for start, ix in _STARTS if m.start(start) >= 0)
    y, mo, mn, d, h, mi, s, f, ap, off, br, nm, num = (m[g] if g else None for g in at)
    if num is not None:
        # The count of digits gives the unit: 10 seconds, 13 milli-, 16 micro-, 19 nanoseconds.
        power = 6 if len(num) <= 11 else 3 if len(num) <= 14 else 0 if len(num) <= 17 else -3 if len(num) <= 20 else None
        if power is None:
            return None
        digits = num + ((f or "") + "000000")[:max(power, 0)]
        us = int(digits) if power >= 0 else int(digits) // 1000
        return ("epoch", us) if us < 253402300800000000 else None
    hour = int(h or 0)
    if ap:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if ap in "pP" else 0)
    month = MONTHS.index(mn[:3].lower()) + 1 if mn else int(mo)
    zone: object = None
    if off:
        zone = _offset_minutes(off)
        if zone is None:
            return None
    elif br or nm:
        name = br or nm
        zone = ABBREVIATIONS.get(name.upper())
        if zone is None:
            zone = _zone(name)
        if zone is None:
            return None
    out = (int(y), month, int(d), hour, int(mi or 0), int(s or 0), f, zone)
    return out if _valid(*out[:6]) else None


def _valid(y: int, mo: int, d: int, h: int, mi: int, s: int) -> bool:
    if not (_UTC_YEARS[0] <= y <= _UTC_YEARS[1] and 1 <= mo <= 12 and h <= 23 and mi <= 59 and s <= 59):
        return False
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return 1 <= d <= (30 + (mo + mo // 8) % 2 if mo != 2 else 28 + leap)


def _micros(fraction: str | None) -> int:
    return int((fraction + "000000")[:6]) if fraction else 0


def days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the Gregorian calendar, by integers; a year begins in March here."""
    y = y - (m <= 2)
    m = np.where(m > 2, m - 3, m + 9)
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * m + 2) // 5 + d - 1 - 719468


def instants(candidates: list[tuple], home: list[str | None]) -> np.ndarray:
    """UTC microseconds, as float with NaN for none, of rows of candidates.

    A row of ``candidates`` is a sequence of (text, fraction tag, offset tag); its
    first readable text decides. ``home`` is each row's zone of last resort.
    """
    n = len(home)
    out, known = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    rows, parts, local_zone = [], [], []
    for i, row in enumerate(candidates):
        for text, fraction, offset in row:
            c = components(text)
            if c is None:
                continue
            if c[0] == "epoch":
                out[i], known[i] = c[1], True
                break
            zone = c[7]
            if zone is None:
                zone = _offset_minutes(offset)
            if zone is None:
                zone = _zone((home[i] or "").strip(_BLANK))
            if zone is None:
                break
            f = c[6]
            if f is None and fraction is not None:
                tag = fraction.strip(_BLANK)
                f = tag if tag.isascii() and tag.isdigit() else None
            rows.append(i)
            parts.append((*c[:6], _micros(f), zone * 60 if isinstance(zone, int) else 0))
            local_zone.append(None if isinstance(zone, int) else zone)
            break
    if rows:
        p = np.array(parts, dtype=np.int64)
        east = p[:, 7].copy()
        for j, zone in enumerate(local_zone):
            if zone is not None:
                offset = datetime(*(int(x) for x in p[j, :6]), tzinfo=zone).utcoffset()
                east[j] = offset.days * 86400 + offset.seconds
        seconds = days(p[:, 0], p[:, 1], p[:, 2]) * 86400 + p[:, 3] * 3600 + p[:, 4] * 60 + p[:, 5] - east
        out[rows], known[rows] = seconds * 1_000_000 + p[:, 6], True
    return pd.arrays.IntegerArray(out, ~known)


@F.pandas_udf(LongType())
def _resolve(frame: pd.DataFrame) -> pd.Series:
    """Columns t0 f0 o0 t1 f1 o1 ... home."""
    cols = {c: frame[c].where(frame[c].notna(), None).tolist() for c in frame.columns}
    k = sum(c.startswith("t") for c in cols)
    rows = list(zip(*(zip(cols[f"t{j}"], cols[f"f{j}"], cols[f"o{j}"]) for j in range(k))))
    return pd.Series(instants(rows, cols["home"]))


# Else a filter on the result would be moved below it, and all texts read twice.
_resolve = _resolve.asNondeterministic()


def utc_us(readings: list[tuple[Column, Column, Column]], home: Column) -> Column:
    """UTC microseconds of the first readable of ``readings`` (text, fraction tag, offset tag), else null."""
    fields = [c.cast("string").alias(f"{n}{j}") for j, r in enumerate(readings) for n, c in zip("tfo", r)]
    return _resolve(F.struct(*fields, home.alias("home")))
