"""Fact extractors: one Column function per fact over whitespace-collapsed text of any length.

Patterns come from ``fixed_values``. Each extractor runs its pattern once: the text is rewritten to the
captured groups behind a control character, which no collapsed text contains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.dates import estimate_delivery
from listing_radar.functions.text import clean_evidence, let

_MARK = "\u0001"


def folded(text: Column) -> Column:
    """Lower case as the patterns compare letters: long s, dotless and dotted i are plain ones."""
    plain = F.replace(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))
    return F.replace(plain, F.lit("\u0307"), F.lit(""))


def _possible(text: Column, pattern: str, low: Column | None) -> Column:
    """The text has the literals without which the pattern cannot match: far cheaper than the pattern, and false for most."""
    low, out = folded(text) if low is None else low, F.lit(True)
    for words in V.PAT_NEEDS.get(pattern, ()):
        out = out & reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return out


def matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """``low``: the folded text, for callers that ask for many facts; here and below it is made where it is not given."""
    return F.coalesce(_possible(text, pattern, low) & text.rlike(V.FLAGS + pattern), F.lit(False))


def first_groups(text: Column, pattern: str, *groups: str, low: Column | None = None) -> Column:
    """Group texts of the first match as an array, null without a match."""
    rewritten = F.regexp_replace(
        text, F.lit(V.FLAGS + "(?s)^.*?(?:" + pattern + ").*$"), F.lit(_MARK + _MARK.join(groups))
    )
    found = let(rewritten, lambda r: F.when(r.startswith(_MARK), F.slice(F.split(r, _MARK), 2, len(groups))))
    return F.when(_possible(text, pattern, low), found)


def _group(found: Column, position: int) -> Column:
    value = F.try_element_at(found, F.lit(position))
    return F.when(value != "", value)


def parse_spanish_decimal(c: Column) -> Column:
    """Euro amount with a decimal comma or thousands dots."""
    def read(text: Column) -> Column:
        comma, dot = F.length(F.substring_index(text, ",", -1)), F.length(F.substring_index(text, ".", -1))
        has_comma, has_dot = text.contains(","), text.contains(".")
        return (
            F.when(has_comma & (~has_dot | (comma < dot)), F.translate(F.replace(text, F.lit("."), F.lit("")), ",", "."))
            .when(has_dot & (dot == 3), F.translate(text, ".,", ""))
            .otherwise(F.translate(text, ",", ""))
        )

    plain = let(F.trim(F.regexp_replace(c, r"(?i)€|eur(os|o)?| ", "")), read)
    return let(plain, lambda p: F.when(p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), p.try_cast("decimal(14,2)")))


def _smallest_and_largest(values: Column, low: str, high: str) -> Column:
    """struct of the first and, if there are two, the last of the distinct sorted values."""
    return let(
        F.array_sort(F.array_distinct(values)),
        lambda v: F.struct(
            F.try_element_at(v, F.lit(1)).alias(low),
            F.when(F.size(v) > 1, F.try_element_at(v, F.lit(-1))).alias(high),
        ),
    )


def _plausible_prices(text: Column, low: Column | None = None) -> Column:
    """Prices that are no monthly amounts. Works on the pieces around every match: 30 characters before
    it (70 in all around it) decide whether the amount is paid per month."""
    end = "\u0002"
    marked = F.regexp_replace(
        text, F.lit(V.FLAGS + "(" + V.PAT_PRICE + ")"), F.lit(_MARK + "$2" + end + "$1" + end)
    )

    def visible(part: Column) -> Column:
        return F.regexp_replace(part, "(?s)^[^" + end + "]*" + end + "|" + end, "")

    def describe(pieces: Column, i: Column) -> Column:
        here = F.element_at(pieces, i)
        start = F.greatest(i - 6, F.lit(1))
        before = F.right(F.array_join(F.transform(F.slice(pieces, start, i - start), visible), ""), F.lit(30))
        after = F.array_join(F.transform(F.slice(pieces, i, F.lit(14)), visible), "")
        match_length = F.length(F.split_part(here, F.lit(end), F.lit(2)))
        window = let(before, lambda b: F.concat(b, F.left(after, match_length + 70 - F.length(b))))
        value = parse_spanish_decimal(F.split_part(here, F.lit(end), F.lit(1)))
        return F.when(~window.rlike(V.FLAGS + V.PAT_MONTHLY), value)

    def read(pieces: Column) -> Column:
        return F.when(
            F.size(pieces) > 1, F.transform(F.sequence(F.lit(2), F.size(pieces)), lambda i: describe(pieces, i))
        ).otherwise(F.array().cast("array<decimal(14,2)>"))

    found = F.filter(let(F.split(marked, _MARK), read), lambda v: v.between(*V.PRICE_RANGE))
    return F.when(_possible(text, V.PAT_PRICE, low), found).otherwise(F.array().cast("array<decimal(14,2)>"))


def price_range(text: Column, low: Column | None = None) -> Column:
    """struct(price_from, price_to): smallest and, if there are two, largest plausible price."""
    return _smallest_and_largest(_plausible_prices(text, low), "price_from", "price_to")


def _decimal_range(text: Column, pattern: str, groups: tuple[str, str], allowed: tuple[int, int], low: Column | None) -> Column:
    def read(pair: Column) -> Column:
        least, most = pair["min"], pair["max"]
        ok = least.between(*allowed) & (most.isNull() | most.between(*allowed))
        return F.struct(F.when(ok, least).alias("min"), F.when(ok, most).alias("max"))

    def numbers(found: Column) -> Column:
        return F.struct(
            parse_spanish_decimal(_group(found, 1)).alias("min"), parse_spanish_decimal(_group(found, 2)).alias("max"))

    return let(let(first_groups(text, pattern, *groups, low=low), numbers), read)


def built_area(text: Column, low: Column | None = None) -> Column:
    return _decimal_range(text, V.PAT_BUILT_AREA, V.BUILT_AREA_GROUPS, V.BUILT_AREA_RANGE, low)


def plot_area(text: Column, low: Column | None = None) -> Column:
    """First plot range; failing that the smallest and largest 'N metros de parcela'."""
    texts = F.regexp_extract_all(text, F.lit(V.FLAGS + V.PAT_PLOT_VALUE), F.lit(1))
    values = F.filter(F.transform(texts, parse_spanish_decimal), lambda v: v.between(*V.PLOT_AREA_RANGE))
    values = F.when(_possible(text, V.PAT_PLOT_VALUE, low), values)
    every = _smallest_and_largest(values, "min", "max")
    first = _decimal_range(text, V.PAT_PLOT_AREA, ("$1", "$2"), V.PLOT_AREA_RANGE, low)
    return let(first, lambda f: F.when(f["min"].isNotNull(), f).otherwise(every))


def _int_range(text: Column, pattern: str, low: Column | None) -> Column:
    def read(found: Column) -> Column:
        least, most = _group(found, 1).try_cast("int"), _group(found, 2).try_cast("int")
        return F.struct(least.alias("min"), F.when(least.isNotNull(), most).alias("max"))

    return let(first_groups(text, pattern, "$1", "$2", low=low), read)


def bedrooms(text: Column, low: Column | None = None) -> Column:
    return _int_range(text, V.PAT_BEDROOMS, low)


def bathrooms(text: Column, low: Column | None = None) -> Column:
    return _int_range(text, V.PAT_BATHROOMS, low)


def garage_spaces(text: Column, low: Column | None = None) -> Column:
    return _int_range(text, V.PAT_GARAGE, low)


def property_types(text: Column, low: Column | None = None) -> Column:
    """Sorted array of the three house types the text names."""
    town = matches(text, V.PAT_TOWNHOUSE, low) & ~matches(text, V.PAT_NOT_TOWNHOUSE, low)
    return F.array_compact(
        F.array(
            F.when(town, F.lit("Adosado")),
            F.when(matches(text, V.PAT_INDEPENDENT, low), F.lit("Independiente")),
            F.when(matches(text, V.PAT_SEMI_DETACHED, low), F.lit("Pareado")),
        )
    )


def private_pool(text: Column, low: Column | None = None) -> Column:
    return F.when(matches(text, V.PAT_PRIVATE_POOL, low), F.lit(True))


def community_pool(text: Column, low: Column | None = None) -> Column:
    return F.when(matches(text, V.PAT_COMMUNITY_POOL, low), F.lit(True))


def commercial_status(text: Column, previous: Column | None = None, low: Column | None = None) -> Column:
    return (
        F.when(matches(text, V.PAT_SOLD_OUT, low), F.lit("soldOut"))
        .when(matches(text, V.PAT_LAST_UNITS, low), F.lit("lastUnits"))
        .when(matches(text, V.PAT_UPCOMING, low), F.lit("upcoming"))
        .when(matches(text, V.PAT_PRE_SALES, low), F.lit("preSales"))
        .when(matches(text, V.PAT_ON_SALE, low), F.lit("onSale"))
        .otherwise(F.lit("unknown") if previous is None else previous)
    )


def construction_status(text: Column, previous: Column | None = None, low: Column | None = None) -> Column:
    return (
        F.when(matches(text, V.PAT_COMPLETED, low), F.lit("completed"))
        .when(matches(text, V.PAT_UNDER_CONSTRUCTION, low), F.lit("underConstruction"))
        .when(matches(text, V.PAT_LICENSED, low), F.lit("licensed"))
        .when(matches(text, V.PAT_LICENCE_REQUESTED, low), F.lit("planned"))
        .otherwise(F.lit("unknown") if previous is None else previous)
    )


def licence_status(text: Column, low: Column | None = None) -> Column:
    return F.when(matches(text, V.PAT_LICENSED, low), F.lit("Concedida")).when(
        matches(text, V.PAT_LICENCE_REQUESTED, low), F.lit("Solicitada")
    )


def delivery(text: Column, low: Column | None = None) -> Column:
    """struct(text, date) of the first delivery statement."""
    def read(found: Column) -> Column:
        return F.struct(
            F.when(found.isNotNull(), clean_evidence(_group(found, 1), 100)).alias("text"),
            estimate_delivery(_group(found, 3).try_cast("int"), _group(found, 2).try_cast("int")).alias("date"),
        )

    return let(first_groups(text, V.PAT_DELIVERY, "$1", "$2", "$3", low=low), read)


def total_units(text: Column, low: Column | None = None) -> Column:
    return _group(first_groups(text, V.PAT_UNITS, "$1", low=low), 1).try_cast("int")


def available_units(text: Column, low: Column | None = None) -> Column:
    stated = _group(first_groups(text, V.PAT_AVAILABLE, "$1$2", low=low), 1).try_cast("int")
    return F.coalesce(stated, F.when(matches(text, V.PAT_SINGLE_AVAILABLE, low), F.lit(1)))


def developer_name(text: Column, low: Column | None = None) -> Column:
    value = _group(first_groups(text, V.PAT_DEVELOPER, "$1", low=low), 1)
    return let(value, lambda v: F.when(v.isNotNull(), clean_evidence(v, 120)))


def brochure_title(text: Column, low: Column | None = None) -> Column:
    value = _group(first_groups(text, V.PAT_BROCHURE_TITLE, "$1", low=low), 1)
    return let(value, lambda v: F.when(v.isNotNull(), clean_evidence(v, 160)))


def is_listing_text(text: Column, low: Column | None = None) -> Column:
    return matches(text, V.PAT_TERMS, low)


def evidence_fragment(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Excerpt with 60 characters on both sides of the first match; '' without a match."""
    full = F.lit(V.FLAGS + pattern)

    def cut(at: Column) -> Column:
        excerpt = F.substring(text, F.greatest(at - 60, F.lit(1)), F.length(F.regexp_substr(text, full)) + 120)
        return F.when(at > 0, clean_evidence(excerpt)).otherwise(F.lit(""))

    return F.when(_possible(text, pattern, low), let(F.regexp_instr(text, full), cut)).otherwise(F.lit(""))
