"""Written forms of dates, each with its pseudonym."""

import datetime
import re

import pytest

from grainmill.llm.pii import pseudonymise

KEY = b"k"
SAME = ["2024-01-05", "2024-01-05T12:00:00Z", "2024-01-05 12:00", "2024/01/05", "2024/1/5", "2024.01.05", "05-01-2024", "5/1/2024", "05.01.2024", "5 January 2024", "5 Jan 2024", "05-Jan-2024", "5th of January 2024", "January 5, 2024", "JAN. 5TH 2024", "5 january, 2024"]
ALONE = ["12/31/24", "31/12/24", "31.12.24", "31-12-24", "31-Dec-24", "1776-07-04", "4 July 1776", "01.02.2150", "9 Sept 2011", "May 1, 1999"]


def new_of(text: str) -> str:
    out, counts = pseudonymise(f"on {text}, then", KEY)
    assert counts == {"date": 1} and out.startswith("on ") and out.endswith(", then") and text not in out
    return out[3:-6]


def day_of(text: str) -> datetime.date:
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    found = [str(names.index(x[:3].lower()) + 1) if x.isalpha() else x for x in re.findall(r"[A-Za-z]{3,}|\d+", re.sub("[Tt].*Z$| 12:00$", "", text))]
    y = next(k for k, x in enumerate(found) if len(x) == 4)
    rest = found[1:] if y == 0 else found[:2][::-1] if not re.match("[A-Za-z]", text) else found[:2]
    return datetime.date(int(found[y]), *map(int, rest))


@pytest.mark.parametrize("text", SAME)
def test_one_day_in_many_forms(text):
    assert day_of(text) == datetime.date(2024, 1, 5)
    assert day_of(new_of(text)) == day_of(new_of("2024-01-05"))


@pytest.mark.parametrize("text", ALONE)
def test_other_dates(text):
    assert re.sub("[A-Za-z]+", "M", re.sub(r"\d+", "9", new_of(text))) == re.sub("[A-Za-z]+", "M", re.sub(r"\d+", "9", text))


def test_pseudonyms_differ():
    days = [datetime.date(1850, 1, 1) + datetime.timedelta(37 * k) for k in range(4000)]
    assert len({new_of(d.isoformat()) for d in days}) == len(days)
    short = {f"{d.day:02d}.{d.month:02d}.{d.year % 100:02d}" for d in days if 1969 <= d.year <= 2068}
    assert len({new_of(x) for x in short}) == len(short)


@pytest.mark.parametrize("text", ["2024-02-30", "32/01/24", "30 February 2024", "1.2.24", "0000-01-01", "may 5 people", "10-20-30-40", "2024-01-05Tx"])
def test_what_is_no_date_stays(text):
    assert pseudonymise(f"on {text}, then", KEY) == (f"on {text}, then", {})
