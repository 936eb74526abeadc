import pytest

from folioforge.functions.dates import normalize_date

FULL = [
    "2026-01-15", "2026-1-5", "2026-01-15T10:00:00Z", "2026-01-15T23:30:00-08:00", "2026-01-15 10:00:00.123+00:00",
    "2026/01/15", "2026.01.15", "20260115", "20260115T101500", "Wed, 11 Mar 2026 19:06:45 GMT", "11 Mar 2026",
    "11-Mar-2026", "11th March 2026", "March 11, 2026", "Mar. 11, 2026", "Sept 3 2026", "Wednesday, March 11, 2026",
    "March 11, 2026 at 7:06 PM", "March 11, 2026 7:06 pm", "03/11/2026", "13/01/2026", "3-11-2026", "15.01.2026",
    "Wed Mar 11 19:06:45 2026", " 2026-01-15 ", "2024-02-29",
    "01/05/24", "13/05/24", "Fri, 05 Jan 24 10:00:00 GMT", "2024 Jan 5", "2024-Jan-05", "20240105101112", "2024-01-05T10",
    "2024-01-05T10Z", "5 January 2024 10am", "10:00 Jan 5, 2024", "January 5th 2024 - 10:30", "5 Jan 75", "01/05/76",
]
KEPT = [
    "soon", "", "  ", "2026-02-30", "2026-13-01", "31/31/2026", "2026-01-15T25:00:00", "2023-02-29", "not 2026-01-15 a date",
    "Foo 11, 2026",
]


def test_full_dates_agree_with_a_general_parser(apply):
    parser = pytest.importorskip("dateutil.parser")
    expected = [parser.parse(v).strftime("%Y-%m-%d") for v in FULL]
    assert dict(zip(FULL, apply(normalize_date, FULL), strict=True)) == dict(zip(FULL, expected, strict=True))


def test_other_texts_are_kept(apply):
    assert apply(normalize_date, KEPT) == KEPT
    assert apply(normalize_date, [None]) == [None]


def test_partial_dates_are_kept_whatever_the_day_of_the_run(apply):
    partial = ["March 2026", "2026", "March 11", "2026-03", "3/11"]
    assert apply(normalize_date, partial) == partial
