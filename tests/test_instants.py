from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.functions.instants import components, days, instants
import numpy as np


def us(text, home=None, fraction=None, offset=None):
    v = instants([[(text, fraction, offset)]], [home])
    return None if v.isna()[0] else int(v[0])


def at(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize("text, home, want", [
    ("2014:11:21 18:24:10", "Europe/Berlin", at(2014, 11, 21, 17, 24, 10)),
    (" 2023:06:02 23:21:03\0", "UTC", at(2023, 6, 2, 23, 21, 3)),
    ("2011:11:17 01:25", "America/New_York", at(2011, 11, 17, 6, 25)),
    ("2012-09-30 10:11:12.123456789", "UTC", at(2012, 9, 30, 10, 11, 12, micro=123456)),
    ("2013-06-16T15:32:17,509+0930", None, at(2013, 6, 16, 6, 2, 17, micro=509000)),
    ("20110129_115033", "Europe/Berlin", at(2011, 1, 29, 10, 50, 33)),
    ("20150219T023001Z", "Europe/Berlin", at(2015, 2, 19, 2, 30, 1)),
    ("2014:11:21 18:24:10" + " " * 250, "UTC", at(2014, 11, 21, 18, 24, 10)),
    ("2014:11:21 18:24:10." + "123456789" * 25, "UTC", at(2014, 11, 21, 18, 24, 10, micro=123456)),
    ("2014:11:21 18:24:10" + " " * 100_000 + "x", "UTC", None),
    ("27.04.2017 05:51:51", "UTC", at(2017, 4, 27, 5, 51, 51)),
    ("05/07/2015 01:19:14 PM", "UTC", at(2015, 5, 7, 13, 19, 14)),
    ("10/01/2014 12:27:57 AM", "UTC", at(2014, 10, 1, 0, 27, 57)),
    ("2020/10/06 23:38:47", "UTC", at(2020, 10, 6, 23, 38, 47)),
    ("Mon, 02 Oct 2017 13:26:02 +0000", None, at(2017, 10, 2, 13, 26, 2)),
    ("19 Jun 2018 18:09", "UTC", at(2018, 6, 19, 18, 9)),
    ("Nov 12, 2013 1:26:17 PM", "UTC", at(2013, 11, 12, 13, 26, 17)),
    ("2011-10-08 23:31:17 EDT", "UTC", at(2011, 10, 9, 3, 31, 17)),
    ("2014-02-03T20:14:18 America/New_York", "UTC", at(2014, 2, 4, 1, 14, 18)),
    ("2018-03-11T03:46:59[America/New_York]", None, at(2018, 3, 11, 7, 46, 59)),
    ("2010-09-26 19:27:32+00", None, at(2010, 9, 26, 19, 27, 32)),
    ("1351394190", None, 1351394190_000000), ("1645406652.90", None, 1645406652_900000), ("1285017907191", None, 1285017907191_000),
    ("1729031134366908", None, 1729031134366908), ("1729031134366908777", None, 1729031134366908),
    ("2021-11-07T01:30:00", "America/New_York", at(2021, 11, 7, 5, 30)),  # twice: the earlier instant
    ("2021:03:14 02:30:00", "America/New_York", at(2021, 3, 14, 7, 30)),  # skipped: the offset before
    ("2021:03:14 02:30:00", None, None), ("2021:03:14 02:30:00", "Mars/Base", None),
    ("2014:02:30 10:15:00", "UTC", None), ("2016:13:04 08:20:11", "UTC", None), ("2018:05:14 25:61:00", "UTC", None),
    ("0000:00:00 00:00:00", "UTC", None), ("    :  :     :  :  ", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("n/a", "UTC", None), ("x" * 10**6, "UTC", None),
])
def test_notations(text, home, want):
    assert us(text, home) == want


def test_tags_give_what_the_text_lacks():
    assert us("2014:11:21 18:24:10", "Asia/Tokyo", "5 ", "+02:00") == at(2014, 11, 21, 16, 24, 10, micro=500000)
    assert us("2014:11:21 18:24:10.25+01:00", "Asia/Tokyo", "5", "+02:00") == at(2014, 11, 21, 17, 24, 10, micro=250000)
    rows = instants([[("bad", None, None), ("2014:11:21 18:24:10", None, "Z")]], [None])
    assert int(rows[0]) == at(2014, 11, 21, 18, 24, 10)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1, 1, 2), datetime(9998, 12, 30)))
def test_day_arithmetic_is_that_of_the_calendar(d):
    assert int(days(np.array([d.year]), np.array([d.month]), np.array([d.day]))[0]) == d.toordinal() - 719163
    assert components(d.strftime("%Y").zfill(4) + d.strftime("-%m-%dT%H:%M:%S"))[:6] == (d.year, d.month, d.day, d.hour, d.minute, d.second)
