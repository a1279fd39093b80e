"""Reading typed values out of free text."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

#: The English words, letters and digits for true and false.
TRUE_WORDS = {"true", "t", "yes", "y", "on", "1"}
FALSE_WORDS = {"false", "f", "no", "n", "off", "0"}
#: English month names; a name may be cut to three letters, September also to four.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

_NUMBER = re.compile(r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d*)?(?:[eE][+-]?\d+)?", re.A)
_INTEGER = re.compile(r"([+-]?)(\d{1,3}(?:,\d{3})+|\d+)(?:\.0*)?", re.A)
_TIME = r"(?:[T ]\s*(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?\s*(?:Z|UTC|GMT|[+-]00:?00)?)?"
_YEAR_FIRST = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME, re.A | re.I)
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})" + _TIME, re.A | re.I)
_DAY_MONTH = re.compile(r"(\d{1,2})(?:st|nd|rd|th)?[ -]+([A-Za-z]{3,9})\.?,?[ -]+(\d{4})" + _TIME, re.A | re.I)
_MONTH_DAY = re.compile(r"([A-Za-z]{3,9})\.?[ -]+(\d{1,2})(?:st|nd|rd|th)?,?[ -]+(\d{4})" + _TIME, re.A | re.I)
_EPOCH = re.compile(r"\d{10}", re.A)
_EPOCH_DAY = dt.date(1970, 1, 1).toordinal()


def _month(name: str) -> int | None:
    name = name.lower()
    for k, full in enumerate(MONTHS, 1):
        if name in (full, full[:3]) or (k == 9 and name == "sept"):
            return k
    return None


def text(value: str) -> str | None:
    return value.strip() or None


def integer(value: str) -> int | None:
    """A whole number that fits a bigint."""
    m = _INTEGER.fullmatch(value.strip())
    if not m:
        return None
    number = int(m[1] + m[2].replace(",", ""))
    return number if -(2**63) <= number < 2**63 else None


def number(value: str) -> Decimal | None:
    """A finite decimal number, exactly as written."""
    value = value.strip()
    mantissa = re.split("[eE]", value)[0]
    if not _NUMBER.fullmatch(value) or not any(c.isdigit() for c in mantissa):
        return None
    found = Decimal(value.replace(",", ""))
    return found if -330 < found.adjusted() < 308 else (Decimal(0) if found.adjusted() <= -330 else None)


def boolean(value: str) -> bool | None:
    word = value.strip().lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def date(value: str) -> int | None:
    """Days since 1970-01-01 of an existing calendar day."""
    value = value.strip()
    if _EPOCH.fullmatch(value):
        return int(value) // 86_400
    if m := _YEAR_FIRST.fullmatch(value):
        y, mo, d = int(m[1]), int(m[3]), int(m[4])
    elif m := _COMPACT.fullmatch(value):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
    elif m := _DAY_MONTH.fullmatch(value):
        y, mo, d = int(m[3]), _month(m[2]), int(m[1])
    elif m := _MONTH_DAY.fullmatch(value):
        y, mo, d = int(m[3]), _month(m[1]), int(m[2])
    else:
        return None
    try:
        return dt.date(y, mo or 0, d).toordinal() - _EPOCH_DAY
    except ValueError:
        return None


#: What reads a value of each declared type.
READERS = {"text": text, "integer": integer, "number": number, "boolean": boolean, "date": date}
