"""Gazetteer and term matching of feed items.

A catalog that passes the size check becomes literals of a per-row expression: no join, no shuffle, and
the text is read once. A larger catalog is matched through exploded keys and an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions import ids, scores
from listing_radar.functions.text import clean_evidence, let, normalize_text, word_ngrams
from listing_radar.functions.urls import is_https_url, normalize_url
from listing_radar.operators.scale import broadcast_if_small, is_small, join_unique, small_rows
from listing_radar.session import cut_to_table

LITERAL_ROWS = 5_000
#: Characters of the grams under which the spellings of a large catalog are filed, and spellings that one text verifies at a time.
ANCHOR_LENGTH, CANDIDATES = 3, 10_000
SCANNED_PHRASES = 100


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Those of the normalized phrases that occur in a normalized text as whole words. Single words are
    looked up in a hash set; a few longer phrases are searched, many are looked up as word runs."""
    words = sorted({p for p in phrases if " " not in p})
    runs = sorted({p for p in phrases if " " in p})
    if len(runs) > SCANNED_PHRASES:
        longest = max(len(p.split(" ")) for p in runs)
        return F.array_intersect(word_ngrams(text, longest), _strings(words + runs))
    hits = F.array_intersect(F.split(text, " "), _strings(words))
    if not runs:
        return hits
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    found = let(padded, lambda p: F.filter(_strings(runs), lambda r: p.contains(F.concat(F.lit(" "), r, F.lit(" ")))))
    return F.concat(hits, found)


def alias_terms(municipalities: DataFrame) -> DataFrame:
    """(term, official, ord, place) of every spelling, for raw containment. Official name, aliases and
    localities register in catalog order; a spelling met again keeps its place and takes the later name."""
    spellings = F.concat(F.array("official_name"), F.coalesce("aliases", F.array().cast("array<string>")),
                         F.coalesce("localities", F.array().cast("array<string>")))
    rows = municipalities.select("ord", "official_name", F.posexplode(spellings).alias("pos", "spelling"))
    rows = rows.withColumn("term", normalize_text(F.col("spelling"))).where("term != ''")
    at = F.struct("ord", "pos")
    return rows.groupBy("term").agg(F.max_by("official_name", at).alias("official"), F.min(at).alias("place"))


def word_terms(municipalities: DataFrame) -> DataFrame:
    """(term, official, ord) for whole-word matching: enabled rows, short aliases left out."""
    none = F.array().cast("array<string>")
    rows = municipalities.where("enabled").select(
        "ord", F.col("official_name").alias("official"),
        F.explode(
            F.concat(
                F.transform(F.concat(F.array("official_name"), F.coalesce("localities", none)), normalize_text),
                F.filter(
                    F.transform(F.coalesce("aliases", none), normalize_text),
                    lambda a: F.length(a) >= V.MIN_ALIAS_LENGTH,
                ),
            )
        ).alias("term"),
    )
    return rows.where("term != ''").groupBy("term").agg(F.min_by("official", "ord").alias("official"),
                                                       F.min("ord").alias("ord"))


def char_grams(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths, each length found in one pass over the text."""
    found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *found))


def anchored_terms(terms: DataFrame) -> DataFrame:
    """``terms`` with ``gram`` added: every term is filed under the one of its grams that the fewest terms have; a term shorter
    than a gram is filed under itself."""
    gram = F.explode(F.when(F.length("term") < ANCHOR_LENGTH, F.array("term")).otherwise(char_grams(F.col("term"), [ANCHOR_LENGTH])))
    parts = terms.select("term", gram.alias("gram"))
    rarity = parts.groupBy("gram").agg(F.count("*").alias("n"))
    anchors = parts.join(rarity, "gram").groupBy("term").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return terms.join(anchors, "term")


class Catalog:
    """The spellings of a gazetteer for several searches: read once, as literals if they are few, else filed under their grams."""

    def __init__(self, municipalities: DataFrame, literal_rows: int = LITERAL_ROWS):
        terms = alias_terms(municipalities)
        self.rows = small_rows(terms, literal_rows)
        self.filed = cut_to_table(anchored_terms(terms)) if self.rows is None else None


def match_catalog(items: DataFrame, text: Column, municipalities: DataFrame | Catalog, name: str,
                  literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Official name of the longest spelling that occurs anywhere in the text (also inside a word).

    A larger catalog is searched through its anchor grams: a text looks up only the grams under which spellings are filed, and the
    spellings found are verified in the text, the longest first. Equal texts are searched once.
    """
    catalog = municipalities if isinstance(municipalities, Catalog) else Catalog(municipalities, literal_rows)
    normalized = normalize_text(text)
    if catalog.rows is not None:
        ranked = sorted(catalog.rows, key=lambda r: (-len(r.term), tuple(r.place)))
        spellings, officials = _strings([r.term for r in ranked]), _strings([r.official for r in ranked])
        # bound, since the optimizer would write the whole normalization into the test of every spelling
        first = let(normalized, lambda x: F.try_element_at(F.filter(spellings, lambda t: x.contains(t)), F.lit(1)))
        found = let(first, lambda f: F.try_element_at(officials, F.nullif(F.array_position(spellings, f), F.lit(0)).cast("int")))
        return items.withColumn(name, found)
    filed = catalog.filed
    sizes = filed.groupBy(F.length("gram").alias("length")).agg(F.count("*").alias("n")).collect()  # a row per gram length
    lists = max(1, -(-sum(r.n for r in sizes) // CANDIDATES))
    keyed = items.withColumn("_text", normalized).withColumn("_id", F.md5("_text"))
    texts = keyed.groupBy("_id").agg(F.min("_text").alias("_text"))
    # explode_outer: before a plain explode the optimizer would compute the grams twice more, to test that there are some
    grams = keyed.select("_id", F.explode_outer(char_grams(F.col("_text"), sorted(r.length for r in sizes))).alias("gram"))
    met = grams.join(broadcast_if_small(filed.select("gram").distinct(), filed), "gram", "left_semi").join(broadcast_if_small(filed), "gram")
    rank = F.struct((-F.length("term")).alias("length"), "place", "term", "official")
    candidates = met.groupBy("_id", F.pmod(F.xxhash64("term"), F.lit(lists)).alias("list")).agg(F.sort_array(F.collect_set(rank)).alias("ranked"))
    inside = candidates.join(texts, "_id").select("_id", F.try_element_at(F.filter("ranked", lambda r: F.col("_text").contains(r["term"])), F.lit(1)).alias("r"))
    best = inside.where("r is not null").groupBy("_id").agg(F.min("r")["official"].alias(name))
    return keyed.drop("_text").join(best, "_id", "left").drop("_id")


def ranked_terms(terms: DataFrame, literal_rows: int = LITERAL_ROWS) -> tuple[list[str], list[str]] | None:
    """Terms and their places, the longest first, catalog order within one length; None if too many."""
    rows = small_rows(terms, literal_rows)
    if rows is None:
        return None
    rows = sorted(rows, key=lambda r: (-len(r.term), r.ord, r.term))
    return [r.term for r in rows], [r.official for r in rows]


def place_of_hits(hits: Column, spellings: list[str], officials: list[str]) -> Column:
    ranks = F.filter(F.transform(hits, lambda t: F.array_position(_strings(spellings), t)), lambda r: r > 0)
    return F.try_element_at(_strings(officials), F.array_min(ranks).cast("int"))


def match_words(items: DataFrame, normalized: Column, municipalities: DataFrame, name: str,
                literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Official name of the longest term that occurs as whole words; catalog order decides ties."""
    terms = word_terms(municipalities)
    ranked = ranked_terms(terms, literal_rows)
    if ranked is not None:
        spellings, officials = ranked
        place = let(normalized, lambda text: place_of_hits(phrase_hits(text, spellings), spellings, officials))
        return items.withColumn(name, place)
    terms = cut_to_table(terms)  # as constants they would be written out into a test of every run
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    keyed = items.withColumn("_text", normalized).withColumn("_id", F.xxhash64("_text"))
    grams = keyed.select("_id", F.explode_outer(word_ngrams(F.col("_text"), longest)).alias("term"))
    best = (
        grams.join(broadcast_if_small(terms), "term")
        .groupBy("_id")
        .agg(F.min_by("official", F.struct(-F.length("term"), F.col("ord"))).alias(name))
    )
    return keyed.drop("_text").join(best, "_id", "left").drop("_id")


def resolve_municipality(items: DataFrame, by_text: Column, municipalities: DataFrame) -> DataFrame:
    """Hint, else the source's fixed place, else the place found in the text. A hint that is not known
    ends the search."""
    known = municipalities.where("enabled").groupBy(F.lower("official_name").alias("_place")).agg(
        F.min_by("official_name", "ord").alias("_official"))
    hint, fixed = F.trim(F.coalesce("municipality_hint", F.lit(""))), F.trim(F.coalesce("fixed_municipality", F.lit("")))
    stated = F.when(hint != "", F.lower("municipality_hint")).when(fixed != "", F.lower("fixed_municipality"))
    out = items.withColumn("_stated", stated)
    out = out.join(broadcast_if_small(known, municipalities), F.col("_stated") == F.col("_place"), "left")
    chosen = F.when(F.col("_stated").isNotNull(), F.col("_official")).otherwise(by_text)
    return out.withColumn("municipality", chosen).drop("_stated", "_place", "_official")


class TermMatcher:
    """Rule, context and exclusion words. Few of them become literals; ``literal`` says so."""

    def __init__(self, terms: DataFrame, context_terms: DataFrame, exclusion_terms: DataFrame, literal_rows: int = LITERAL_ROWS):
        lists = [_norm_terms(df).where("n != ''") for df in (terms, context_terms, exclusion_terms)]
        known = [small_rows(df, literal_rows) for df in lists]
        self.literal = all(rows is not None for rows in known)
        if self.literal:
            self.rules, self.context, self.excluded = known[0], [r.n for r in known[1]], [r.n for r in known[2]]
        else:
            none = F.lit(None).cast("string")
            rules, *words = lists
            self.table = rules.select("n", "term", "kind", F.lit("rule").alias("role"))
            for df, role in zip(words, ("context", "excluded"), strict=True):
                self.table = self.table.unionByName(df.select("n", none.alias("term"), none.alias("kind"), F.lit(role).alias("role")))

    @property
    def phrases(self) -> list[str]:
        return [r.n for r in self.rules] + self.context + self.excluded

    def facts(self, hits: Column) -> dict[str, Column]:
        rules = F.array(*[
            F.struct(F.lit(r.n).alias("n"), F.lit(r.term).alias("term"), F.lit(r.kind).alias("kind")) for r in self.rules])
        matched = F.transform(
            F.filter(rules, lambda r: F.array_contains(hits, r["n"])),
            lambda r: F.struct(r["term"].alias("term"), r["kind"].alias("kind")),
        )
        return {
            "matched_rules": matched,
            "has_context": F.arrays_overlap(hits, _strings(self.context)),
            "is_excluded": F.arrays_overlap(hits, _strings(self.excluded)),
        }

    def joined(self, items: DataFrame, normalized: Column, places: DataFrame | None = None) -> DataFrame:
        """The same facts for lists of any size: the word runs of every text meet the words by equality. With ``places`` (see
        ``word_terms``) the same runs find the place, as ``_by_text``.

        Texts are cut into runs where they stand, only hits are shuffled. Equal texts give equal hits, which the set takes once; words
        that a list has several times are counted there and come back as often.
        """
        # written once: of a catalog made of constants the optimizer would test every run against each normalization written out
        table = self.table.withColumn("ord", F.lit(None).cast("long"))
        if places is not None:
            table = table.unionByName(places.select(F.col("term").alias("n"), F.col("official").alias("term"), F.lit(None).cast("string").alias("kind"),
                                                    F.lit("place").alias("role"), F.col("ord").cast("long").alias("ord")))
        words = cut_to_table(table.groupBy(*table.columns).agg(F.count(F.lit(1)).cast("int").alias("times")))
        longest = words.agg(F.max(F.size(F.split("n", " ")))).first()[0] or 1
        keyed = items.withColumn("_text", normalized).withColumn("_id", F.md5("_text"))
        # explode_outer: before a plain explode the optimizer would compute the runs twice more, to test that there are some
        runs = keyed.select("_id", F.explode_outer(word_ngrams(F.col("_text"), longest)).alias("n"))
        rule = F.when(F.col("role") == "rule", F.struct("term", "kind", "n", "times"))
        is_place = F.col("role") == "place"
        place = F.min_by(F.when(is_place, F.col("term")), F.when(is_place, F.struct(-F.length("n"), F.col("ord"))))
        met = runs.join(broadcast_if_small(words), "n").groupBy("_id").agg(
            *([] if places is None else [place.alias("_by_text")]),
            F.sort_array(F.collect_set(rule)).alias("_rules"),  # collect_set leaves nulls out
            F.bool_or(F.col("role") == "context").alias("has_context"), F.bool_or(F.col("role") == "excluded").alias("is_excluded"))
        told = F.flatten(F.transform("_rules", lambda r: F.array_repeat(F.struct(r["term"].alias("term"), r["kind"].alias("kind")), r["times"])))
        met = met.withColumn("matched_rules", told).drop("_rules")
        out = keyed.drop("_text").join(met, "_id", "left").drop("_id")
        none = F.array().cast("array<struct<term:string,kind:string>>")
        return out.withColumns({"matched_rules": F.coalesce("matched_rules", none), "has_context": F.coalesce("has_context", F.lit(False)), "is_excluded": F.coalesce("is_excluded", F.lit(False))})


def _norm_terms(df: DataFrame) -> DataFrame:
    """A word list with its normalized words as ``n``."""
    return df.select(normalize_text(F.col("term")).alias("n"), *df.columns)


def match_terms(items: DataFrame, normalized: Column, terms: DataFrame, context_terms: DataFrame,
                exclusion_terms: DataFrame, literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Adds matched_rules (array of term and kind), has_context and is_excluded, all by whole words."""
    matcher = TermMatcher(terms, context_terms, exclusion_terms, literal_rows)
    if not matcher.literal:
        return matcher.joined(items, normalized)

    def facts(hits: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in matcher.facts(hits).items()])

    found = let(let(normalized, lambda text: phrase_hits(text, matcher.phrases)), facts)
    return items.select("*", F.inline(F.array(found)))


def dominant_kind(matched_rules: Column) -> Column:
    """Most frequent kind of the matched rules; the lower ordinal wins a tie."""
    def count(kind: str) -> Column:
        return F.size(F.filter(matched_rules, lambda r: r["kind"] == kind))

    ranked = F.array(
        *[
            F.struct(count(kind).alias("n"), F.lit(-position).alias("o"), F.lit(kind).alias("kind"))
            for position, kind in enumerate(V.OPPORTUNITY_KIND)
        ]
    )
    return F.array_max(ranked)["kind"]


def sorted_terms(matched_rules: Column) -> Column:
    """Distinct terms whatever the case, the first spelling kept, in case-blind order."""
    names = F.transform(matched_rules, lambda r: r["term"])
    lowered = F.transform(names, F.lower)
    firsts = F.filter(names, lambda n, i: F.array_position(lowered, F.lower(n)) == i + 1)
    return F.transform(
        F.array_sort(F.transform(firsts, lambda n: F.struct(F.upper(n).alias("u"), n.alias("n")))), lambda s: s["n"]
    )


def review_rule_status(url: Column, rules: Column) -> Column:
    """Status of the first rule whose pattern occurs in the URL, whatever the case; null without one."""
    low = F.lower(url)
    return F.try_element_at(F.filter(rules, lambda r: low.contains(F.lower(r["url_pattern"]))), F.lit(1))["status"]


def mark_known_urls(items: DataFrame, url: str, known_urls: DataFrame, row_key: str) -> DataFrame:
    """Adds ``is_known``: the normalized URL belongs to a known listing."""
    known = known_urls.select(F.lower(normalize_url(F.col("url"))).alias("_url")).distinct().withColumn("_known", F.lit(True))
    keyed = items.withColumn("_url", F.lower(normalize_url(F.col(url))))
    if is_small(known_urls):
        out = keyed.join(F.broadcast(known), "_url", "left")
    else:
        out = join_unique(keyed, known, ["_url"], F.col(row_key))
    return out.withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_url", "_known")


def related_https(urls: Column, limit: int = 10) -> Column:
    """First ``limit`` distinct https links of an item, in their order."""
    kept = F.filter(urls, is_https_url)
    lowered = F.transform(kept, F.lower)
    return F.slice(F.filter(kept, lambda u, i: F.array_position(lowered, F.lower(u)) == i + 1), 1, limit)


def match_items(items: DataFrame, sources: DataFrame, municipalities: DataFrame, terms: DataFrame,
                context_terms: DataFrame, exclusion_terms: DataFrame, known_urls: DataFrame | None,
                observed_at: Column, literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Feed items to candidates: place, at least one rule, a context word and no exclusion word."""
    config = sources.select(
        "source_id", "source_name", "source_kind", "fixed_municipality", "ignore_exclusion_terms", "review_rules")
    out = items.join(broadcast_if_small(config), "source_id")
    matcher, places = TermMatcher(terms, context_terms, exclusion_terms, literal_rows), word_terms(municipalities)
    whole = F.col("search_text") if "search_text" in items.columns else F.lit(None).cast("string")
    text = normalize_text(F.coalesce(whole, F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))))
    ranked = ranked_terms(places, literal_rows) if matcher.literal else None
    literal, (spellings, officials) = ranked is not None, ranked or ([], [])

    def facts(hits: Column) -> Column:
        place = place_of_hits(hits, spellings, officials) if literal else F.lit(None).cast("string")
        return F.struct(*[c.alias(n) for n, c in matcher.facts(hits).items()], place.alias("_by_text"))

    def wanted(found: Column) -> Column:
        return ((F.size(found["matched_rules"]) > 0) & found["has_context"]
                & (F.col("ignore_exclusion_terms") | ~found["is_excluded"]))

    # a generator keeps the filter and the columns on one evaluation of the text
    if matcher.literal:
        found = let(let(text, lambda t: phrase_hits(t, matcher.phrases + spellings)), facts)
        out = out.select("*", F.inline(F.filter(F.array(found), wanted)))
    else:
        told = F.struct("matched_rules", "has_context", "is_excluded")
        out = matcher.joined(out, text, places).where(wanted(told))
    out = out.withColumn("_row", F.concat_ws("|", "source_id", "external_id", "official_url"))
    if matcher.literal and not literal:
        out = match_words(out.drop("_by_text"), text, municipalities, "_by_text", literal_rows)
    out = resolve_municipality(out, F.col("_by_text"), municipalities).where("municipality is not null")
    if known_urls is None:
        out = out.withColumn("is_known", F.lit(False))
    else:
        out = mark_known_urls(out, "official_url", known_urls, "_row")
    status = F.when(F.col("is_known"), F.lit("verifiedSource")).otherwise(
        F.coalesce(review_rule_status(F.col("official_url"), F.col("review_rules")), F.lit("new")))
    return out.select(
        ids.candidate_id(F.col("source_id"), F.col("external_id"), F.col("official_url"), F.col("municipality")).alias("id"),
        "source_id", "source_name", "source_kind",
        clean_evidence(F.col("external_id"), 160).alias("external_id"),
        clean_evidence(F.col("title"), 240).alias("title"),
        clean_evidence(F.col("summary"), 800).alias("summary"),
        "official_url",
        related_https(F.col("related_urls")).alias("related_urls"),
        F.col("published_at").alias("published_at_utc"),
        "municipality",
        dominant_kind(F.col("matched_rules")).alias("kind"),
        scores.candidate_confidence(F.col("source_kind"), F.size("matched_rules")).alias("confidence"),
        sorted_terms(F.col("matched_rules")).alias("matched_terms"),
        observed_at.alias("first_seen_utc"),
        observed_at.alias("last_seen_utc"),
        status.alias("status"),
        "seq",
    )
