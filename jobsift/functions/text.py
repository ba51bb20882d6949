"""Text scalars (C1-C9) as native Spark column expressions.

Every function takes and returns ``Column`` objects, so they compose inside
``select``/``filter``/``transform`` and stay in whole-stage codegen.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for identical results) ----------
# Stop words dropped from a search term before the title check.
STOP_WORDS = (
    "de", "da", "do", "das", "dos", "em", "para", "com", "e", "o", "a",
    "analista", "pessoa", "pleno", "senior", "junior", "sr", "jr", "of", "and", "for", "in",
)
# Characters kept of a CV for scoring.
CV_MAX_CHARS = 15000
# A description this short (or shorter) is replaced by the title when scoring.
MIN_DESCRIPTION_CHARS = 50
# Section headers of the scoring request.
CV_HEADER = "--- CANDIDATE CV ---\n"
JOB_HEADER = "--- TARGET JOB DESCRIPTION ---\n"
# ---------------------------------------------------------------------------

# The code points that Python's str methods and ``\\s`` count as white space, as the body of
# a Java character class (Java's own ``\\s`` is ASCII only).
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LAST = 0x30000


def _spelled(ch: str) -> list[str]:
    """A character's canonical decomposition, followed to its end."""
    told = unicodedata.decomposition(ch)
    if not told or told.startswith("<"):
        return [ch]
    return [x for code in told.split() for x in _spelled(chr(int(code, 16)))]


def _unmarked(text: str) -> str:
    """The text's decomposed characters without combining marks."""
    return "".join(x for ch in text for x in _spelled(ch) if unicodedata.category(x) != "Mn")


def _code_points(first: int):
    return (chr(cp) for cp in range(first, _LAST) if not 0xD800 <= cp <= 0xDFFF)


@functools.lru_cache(maxsize=None)
def _strict_tables() -> tuple[str, str]:
    """``translate`` strings that fold every letter and space the later steps keep.

    A code point beyond ASCII is kept only where its lower-case form is one of a-z, 0-9
    with marks, or white space; all others are deleted by the next step anyway.
    """
    folded = {chr(cp): " " for cp in range(0x1C, 0x20)}
    for ch in _code_points(0x80):
        if ch.isspace():
            folded[ch] = " "
        elif len(kept := [x for x in _unmarked(ch.lower()) if x in _LETTERS]) == 1:
            folded[ch] = kept[0]
    return "".join(folded), "".join(folded.values())


@functools.lru_cache(maxsize=None)
def _legacy_tables() -> tuple[str, str, dict[str, str]]:
    """``translate`` strings for lower case without marks, everything else kept, and the
    characters that become none or several.

    Marks come last and have no counterpart, so ``translate`` deletes them. Hangul syllables
    are left to ``_jamo``.
    """
    folded, marks, longer = {}, [], {}
    for ch in _code_points(0x80):
        if "\uac00" <= ch <= "\ud7a3":
            continue
        plain = _unmarked(ch.lower())
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
        elif len(plain) != 1:
            longer[ch] = plain
        elif plain != ch.lower():
            folded[ch] = plain
    return "".join([*folded, *marks]), "".join(folded.values()), longer


def _jamo(ch: Column) -> Column:
    """The two or three letters of a Hangul syllable, by arithmetic on its code point."""
    at = F.ascii(ch) - 0xAC00
    lead, vowel, tail = 0x1100 + F.floor(at / 588), 0x1161 + F.floor(at % 588 / 28), at % 28
    spelled = F.concat(F.hex(lead.cast("long")), F.hex(vowel.cast("long")), F.when(tail > 0, F.hex((0x11A7 + tail).cast("long"))).otherwise(""))
    return F.decode(F.unhex(spelled), "UTF-16BE")


def _expanded(x: Column) -> Column:
    """Characters that decompose to none or several, spelled out; other texts as they are."""
    longer = _legacy_tables()[2]
    table = F.create_map(*[F.lit(v) for pair in longer.items() for v in pair])

    def spelled(ch: Column) -> Column:
        return F.when((ch >= "\uac00") & (ch <= "\ud7a3"), _jamo(ch)).otherwise(F.coalesce(F.try_element_at(table, ch), ch))

    rare = "[\uac00-\ud7a3" + "".join(longer) + "]"
    return F.when(x.rlike(rare), F.array_join(F.transform(F.split(x, ""), spelled), "")).otherwise(x)


@functools.lru_cache(maxsize=None)
def _digit_tables() -> tuple[str, str]:
    """The decimal digits of all scripts beyond ASCII, and their ASCII forms."""
    digits = [ch for ch in _code_points(0x80) if unicodedata.category(ch) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(ch)) for ch in digits)


def plain_digits(c: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    return F.translate(c, *_digit_tables())


def py_strip(c: Column) -> Column:
    """``str.strip()``: white space of any script off both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text_py(s: str | None) -> str:
    """C1 for driver-side parameters, by the same tables as the columns."""
    folded = (s or "").translate(str.maketrans(*_strict_tables())).lower()
    return " ".join("".join(x for x in folded if x in _LETTERS or x.isspace()).split())


_BLANK = "\t\n\x0b\x0c\r"
_DROPPED = "".join(x for x in map(chr, range(128)) if not (x.isdigit() or "a" <= x <= "z" or x == " " or x in _BLANK))


def normalize_text(c: Column | str) -> Column:
    """Lower, strip accents, keep [a-z0-9], collapse whitespace, trim. Null -> ''."""
    src, dst = _strict_tables()
    folded = F.lower(F.translate(F.coalesce(_col(c), F.lit("")), src, dst))
    # a pattern that matches at every space or stop costs twenty times a translation
    kept = F.translate(F.regexp_replace(folded, r"[^\x00-\x7F]+", ""), _BLANK + _DROPPED, " " * len(_BLANK))
    return F.trim(F.regexp_replace(kept, r" {2,}", " "))


def normalize_text_legacy(c: Column | str) -> Column:
    """Lower and strip accents only; punctuation and spacing stay. Null -> ''."""
    src, dst, _ = _legacy_tables()
    return F.lower(F.translate(_expanded(F.coalesce(_col(c), F.lit(""))), src, dst))


def fingerprint(title_norm: Column | str, company_norm: Column | str) -> Column:
    """Normalised title and company glued without separator (the reference's key)."""
    return F.concat(_col(title_norm), _col(company_norm))


def term_tokens(term_norm: Column | str, stop_words=STOP_WORDS) -> Column:
    """C4: words of the normalised term, minus stop words and words of <= 2 chars."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(F.split(_col(term_norm), " "), lambda t: (~F.array_contains(stop, t)) & (F.length(t) > 2))


def required_words(filter_words: Column | str) -> Column:
    """Comma list -> normalised words, empties dropped."""
    parts = F.split(F.coalesce(_col(filter_words), F.lit("")), ",")
    return F.filter(F.transform(parts, lambda w: normalize_text(w)), lambda w: w != "")


def truncate_cv(cv_text: Column | str, max_chars: int = CV_MAX_CHARS) -> Column:
    """First 15 000 characters of the CV (null -> '')."""
    return F.substring(F.coalesce(_col(cv_text), F.lit("")), 1, max_chars)


def source_lower(site: Column | str) -> Column:
    """Lower-cased site name, 'unknown' if missing."""
    return F.lower(F.coalesce(_col(site), F.lit("unknown")))


def scoring_text(description: Column | str, title: Column | str) -> Column:
    """The description if longer than 50 characters, else the title."""
    d = _col(description)
    return F.when(d.isNotNull() & (F.length(d) > MIN_DESCRIPTION_CHARS), d).otherwise(_col(title))


def request_text(cv_text: Column | str, job_text: Column | str) -> Column:
    """The scoring request body built from the truncated CV and the job text."""
    return F.concat(F.lit(CV_HEADER), truncate_cv(cv_text), F.lit("\n\n"), F.lit(JOB_HEADER), F.coalesce(_col(job_text), F.lit("")))


def padded_contains(haystack_norm: Column, needle_norm: Column) -> Column:
    """Whole-word phrase test on normalised text (single spaces, no edges).

    Same as ``(' '+hay+' ').contains(' '+needle+' ')`` without copying the (possibly
    very long) haystack: equal, a prefix, a suffix or an interior occurrence.
    """
    sp = F.lit(" ")
    return (
        (haystack_norm == needle_norm)
        | haystack_norm.startswith(F.concat(needle_norm, sp))
        | haystack_norm.endswith(F.concat(sp, needle_norm))
        | haystack_norm.contains(F.concat(sp, needle_norm, sp))
    )


def whole_phrase(desc_norm: Column, term_norm: Column) -> Column:
    """The whole normalised term between word boundaries; empty term -> text not empty."""
    return F.when(term_norm == "", desc_norm != "").otherwise(padded_contains(desc_norm, term_norm))


def title_any_token(title_norm: Column, tokens: Column) -> Column:
    """Some kept term word is a substring of the normalised title; no words -> false."""
    return F.exists(tokens, lambda t: title_norm.contains(t))
