"""Date scalars (F1-F4): relative/mixed date texts -> 'dd/MM/yyyy' strings.

``as_of`` replaces the wall clock so results repeat. All parsing is ANSI-safe
(``try_cast``/``try_to_date``); nothing here raises on bad input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsift.functions.text import SPACE, plain_digits, py_strip

# --- fixed values (must equal the reference for identical results) ----------
# Texts treated as "no date".
NO_DATE_TEXTS = ("none", "nan", "n/a", "")
# Any of these substrings means "posted today".
IMMEDIATE_WORDS = (
    "seg", "sec", "second", "segundo", "min", "minuto", "minute", "h", "hora", "hour", "hr",
    "agora", "now", "today", "hoje", "just now",
)
DAYS_PATTERN = r"(\d+)\s*(d|dia|day)s?"
WEEKS_PATTERN = r"(\d+)\s*(w|sem|semana|week)s?"
MONTHS_PATTERN = r"(\d+)\s*(m|mes|month|mês)s?"
ISO_PREFIX = r"^(\d{4}-\d{2}-\d{2})"
# Month and day as the date parser reads them: only some places take digits of other scripts.
ISO_MONTH_DAY = r"(1[0-2]|0[1-9])-(3[01]|[12]\p{Nd}|0[1-9])"
BR_PREFIX = r"^\d{2}/\d{2}/\d{4}"
OUT_FORMAT = "dd/MM/yyyy"
MISSING = "N/A"
# ---------------------------------------------------------------------------

_YEAR_ONE = "0001-01-01"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _as_of(as_of) -> Column:
    return F.to_date(F.lit(str(as_of)))


def _shift(as_of: Column, digits: Column, days_per_unit: int) -> Column:
    """as_of minus n units, or null if n does not fit a date >= year 1 (Python overflows)."""
    n = digits.try_cast("bigint")
    room = F.datediff(as_of, F.to_date(F.lit(_YEAR_ONE)))
    return F.when(n <= F.floor(room / F.lit(days_per_unit)), F.date_sub(as_of, (n * days_per_unit).cast("int")))


def _relative_parts(raw: Column, as_of) -> tuple[Column, Column, Column]:
    """Shared core of F1: (no_date, matched, date) for a raw text.

    ``matched`` says a rule fired; ``date`` is null when the rule fired but the
    number does not fit (the reference raises there).
    """
    today = _as_of(as_of)
    no_date = raw.isNull() | F.lower(raw).isin(*NO_DATE_TEXTS)
    text = plain_digits(F.regexp_replace(F.lower(py_strip(raw)), f"[{SPACE}]+", " "))
    # The words are plain letters, so one alternation equals "any word is a substring".
    immediate = text.rlike("|".join(IMMEDIATE_WORDS))
    # Group 1 is \d+, non-empty exactly when the pattern matches.
    days = F.regexp_extract(text, DAYS_PATTERN, 1)
    weeks = F.regexp_extract(text, WEEKS_PATTERN, 1)
    months = F.regexp_extract(text, MONTHS_PATTERN, 1)
    has_days, has_weeks, has_months = days != "", weeks != "", months != ""
    matched = (~no_date) & (immediate | has_days | has_weeks | has_months)
    date = (
        F.when(no_date, F.lit(None).cast("date"))
        .when(immediate, today)
        .when(has_days, _shift(today, days, 1))
        .when(has_weeks, _shift(today, weeks, 7))
        .when(has_months, _shift(today, months, 30))
    )
    return no_date, F.coalesce(matched, F.lit(False)), date


def relative_date(raw: Column | str, as_of="2024-02-01") -> Column:
    """relative text ('3 days ago', 'há 2 semanas', ...) -> 'dd/MM/yyyy' or null."""
    _, _, date = _relative_parts(_col(raw), as_of)
    return F.date_format(date, OUT_FORMAT)


def format_date(raw: Column | str, as_of="2024-02-01") -> Column:
    """any posting date text -> 'dd/MM/yyyy', the raw dd/mm/yyyy text, a 10-char prefix or 'N/A'."""
    r = _col(raw)
    missing = r.isNull() | F.lower(r.cast("string")).isin(*NO_DATE_TEXTS)
    s = py_strip(r.cast("string"))
    plain = plain_digits(s)
    iso_date = F.try_to_date(F.regexp_extract(plain, ISO_PREFIX, 1), "yyyy-MM-dd")
    iso_ok = s.rlike(r"^\p{Nd}{4}-" + ISO_MONTH_DAY) & iso_date.isNotNull() & (F.year(iso_date) >= 1)
    _, matched, rel = _relative_parts(s, as_of)
    return (
        F.when(missing, F.lit(MISSING))
        .when(plain.rlike(ISO_PREFIX), F.when(iso_ok, F.date_format(iso_date, OUT_FORMAT)).otherwise(F.lit(MISSING)))
        .when(plain.rlike(BR_PREFIX), s)
        .when(matched, F.coalesce(F.date_format(rel, OUT_FORMAT), F.lit(MISSING)))
        .otherwise(F.substring(s, 1, 10))
    )


def format_date_value(d: Column) -> Column:
    """F2 for date/timestamp-typed input: format it, null -> 'N/A'."""
    return F.coalesce(F.date_format(d, OUT_FORMAT), F.lit(MISSING))


def format_date_legacy(raw: Column | str) -> Column:
    """legacy rule: text before the first 'T', first word; an ISO date there is
    reformatted, anything else is returned unchanged."""
    r = _col(raw).cast("string")
    head = F.substring_index(r, "T", 1)
    word = F.try_element_at(F.filter(F.split(head, f"[{SPACE}]+"), lambda w: w != ""), F.lit(1))
    m = F.regexp_extract(word, r"^\p{Nd}{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\p{Nd}|0[1-9]|[1-9])$", 0)
    plain = plain_digits(word)
    y = F.regexp_extract(plain, r"^(\d{4})-", 1)
    mo = F.regexp_extract(plain, r"^\d{4}-(\d{1,2})-", 1)
    dd = F.regexp_extract(plain, r"-(\d{1,2})$", 1)
    iso = F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(dd, 2, "0"))
    parsed = F.when(m != "", F.try_to_date(iso, "yyyy-MM-dd"))
    ok = parsed.isNotNull() & (F.year(parsed) >= 1)
    return (
        F.when(r.isNull() | (r == "") | (F.lower(r) == "none"), F.lit(MISSING))
        .when(word.isNotNull() & word.contains("-") & ok, F.date_format(parsed, OUT_FORMAT))
        .otherwise(r)
    )


def created_stamp(as_of="2024-02-01") -> Column:
    """processing date as 'dd/MM/yyyy'."""
    return F.date_format(_as_of(as_of), OUT_FORMAT)
