"""Text expressions: folding, clean-up, word n-grams. All of them stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from listing_radar.fixed_values import COMPANY_SUFFIXES, EVIDENCE_LENGTH


def _accent_map() -> tuple[str, str]:
    """Single-letter base of every accented lower-case Latin letter, derived from the Unicode data."""
    plain, accented = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char and char == char.lower():
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_map()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_accents(c: Column) -> Column:
    """Lower case without accents, for composed and for decomposed input."""
    def fold(low: Column) -> Column:
        return F.regexp_replace(F.translate(low, _ACCENTED, _PLAIN), r"\p{Mn}+", "")

    # most texts have no accent at all and skip the character map
    return let(F.lower(c), lambda low: F.when(low.rlike(r"[^\x00-\x7F]"), fold(low)).otherwise(low))


def normalize_text(c: Column) -> Column:
    """Fold accents, turn everything but letters and digits into single spaces; null becomes ''."""
    return F.trim(F.regexp_replace(fold_accents(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]+", " "))


def normalize_title(c: Column) -> Column:
    """Fold accents and collapse blanks, but keep punctuation."""
    return F.trim(F.regexp_replace(fold_accents(F.coalesce(c, F.lit(""))), r"[ \t\r\n]+", " "))


def normalize_company(c: Column) -> Column:
    """``normalize_text`` without legal-form endings; each ending is cut at most once, in list order."""
    out = normalize_text(c)
    for suffix in COMPANY_SUFFIXES:
        out = F.trim(F.regexp_replace(out, suffix + "$", ""))
    return out


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_evidence(c: Column, length: int = EVIDENCE_LENGTH) -> Column:
    """Collapse blanks; a longer text is cut and ends in an ellipsis (a display excerpt)."""
    return let(
        collapse_whitespace(c),
        lambda clean: F.when(F.length(clean) <= length, clean).otherwise(
            F.concat(F.substring(clean, 1, length - 1), F.lit("…"))
        ),
    )


def contains_any(c: Column, terms: list[str]) -> Column:
    """True if one of the literal terms is a substring; false for an empty list."""
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def contains_any_ci(c: Column, terms: Column) -> Column:
    """True if a string of the array column occurs in ``c``, whatever the case."""
    low = F.lower(c)
    return F.coalesce(F.exists(terms, lambda t: low.contains(F.lower(t))), F.lit(False))


def contains_location(corpus: Column, place: Column) -> Column:
    """Place name as it is, or with everything but letters and digits removed on both sides."""
    def compact(value: Column) -> Column:
        return F.regexp_replace(value, r"[^\p{L}\p{Nd}]+", "")

    return (F.length(place) > 0) & (corpus.contains(place) | compact(corpus).contains(compact(place)))


def historical_year(c: Column, year: Column | int) -> Column:
    """Mentions any year from 2000 to two years ago."""
    last = (F.lit(year) if isinstance(year, int) else year) - 2
    years = F.when(last >= 2000, F.sequence(F.lit(2000), last)).otherwise(F.array().cast("array<int>"))
    return F.exists(years, lambda y: c.contains(y.cast("string")))


def word_ngrams(normalized: Column, longest: int) -> Column:
    """Distinct runs of 1..``longest`` words of an already normalized text."""
    def runs(words: Column, n: int) -> Column:
        # a slice at every word would copy the whole text each time
        starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))

    def grams(words: Column) -> Column:
        return F.array_distinct(F.concat(words, *[runs(words, n) for n in range(2, longest + 1)]))

    return let(F.filter(F.split(normalized, " "), lambda w: w != ""), grams)
