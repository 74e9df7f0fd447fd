"""Deduplication of listings that share a URL or a fingerprint, without gathering any group.

In (url, name) order a listing becomes a survivor unless an earlier survivor has its URL or its
fingerprint; otherwise it merges into the first such survivor. Read a listing as an edge between its URL
and its fingerprint: the survivors are the greedy matching of the edges in that order. A matching is
found in rounds of minima: an edge that comes first at both of its ends is a survivor, and it removes
every other edge at these ends. Each round is two map-side combined aggregates and joins on unique keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listing_radar import fixed_values as V
from listing_radar.functions.ids import fingerprint
from listing_radar.functions.scores import ordinal
from listing_radar.functions.text import normalize_text
from listing_radar.functions.urls import normalize_url
from listing_radar.operators.scale import HEAVY_ROWS, attach_group_values, join_unique
from listing_radar.session import cut_to_table


def _keyed(promotions: DataFrame) -> DataFrame:
    """Adds the two ends and the place in the order. A fingerprint of empty parts never joins listings."""
    mark = fingerprint(F.col("name"), F.col("municipality"), F.col("developer_name"))
    return promotions.select(
        "*",
        normalize_url(F.col("canonical_url")).alias("_u"),
        F.when(F.length(mark) > 2, mark).otherwise(F.concat(F.lit("#"), F.col("row_id").cast("string"))).alias("_f"),
        F.struct("canonical_url", "name", "row_id").alias("_o"),
    )


def _closest(edges: DataFrame, end: str, name: str, heavy_rows: int | None) -> DataFrame:
    """Attach to every edge the first place among the edges at one of its ends."""
    first = edges.groupBy(end).agg(F.min("_o").alias(name), F.count(F.lit(1)).alias("_n"))
    return attach_group_values(edges, first, [end], "_n", F.col("_o"), heavy_rows).drop("_n")


def _taken(edges: DataFrame, survivors: DataFrame, end: str, flag: str, heavy_rows: int | None) -> DataFrame:
    hit = survivors.select(end).withColumn(flag, F.lit(True))
    return join_unique(edges, hit, [end], F.col("_o"), heavy_rows)


def _second(ranked: DataFrame, end: str, first: str, name: str, heavy_rows: int | None) -> DataFrame:
    """Attach to every edge the second place at one of its ends."""
    later = ranked.where(F.col("_o") > F.col(first)).groupBy(end).agg(F.min("_o").alias(name))
    return join_unique(ranked, later, [end], F.col("_o"), heavy_rows)


def _along_chains(ranked: DataFrame, heavy_rows: int | None) -> DataFrame:
    """Survivors among the first edges and the chains that hang on them.

    An edge with one earlier neighbour only survives exactly if that neighbour does not. Pointer doubling takes every edge of such
    a chain to its start, with the number of steps: from a first edge, those at even distance survive.
    """
    both = _second(_second(ranked, "_u", "_first_u", "_second_u", heavy_rows), "_f", "_first_f", "_second_f", heavy_rows)
    place, node = F.col("_o"), F.col("_o.row_id")
    first_u, first_f = place == F.col("_first_u"), place == F.col("_first_f")
    up = F.when(first_f & (place == F.col("_second_u")), F.col("_first_u.row_id")).when(first_u & (place == F.col("_second_f")), F.col("_first_f.row_id"))
    both = cut_to_table(both.select("_u", "_f", "_o", node.alias("_node"), up.alias("_up"), (first_u & first_f).alias("_starts")))
    chain = both.select("_node", F.coalesce("_up", "_node").alias("_up"), F.col("_up").isNotNull().cast("long").alias("_steps"))
    while True:
        above = chain.select(F.col("_node").alias("_up"), F.col("_up").alias("_above"), F.col("_steps").alias("_more"))
        chain = cut_to_table(chain.join(above, "_up").select(
            "_node", F.col("_above").alias("_up"), (F.col("_steps") + F.col("_more")).alias("_steps"), (F.col("_more") > 0).alias("_moved")))
        if not chain.agg(F.max("_moved")).first()[0]:
            break
        chain = chain.drop("_moved")
    starts = both.where("_starts").select(F.col("_node").alias("_up"))
    alive = chain.where("_steps % 2 = 0").join(starts, "_up", "left_semi").select("_node")
    return both.join(alive, "_node", "left_semi").select("_u", "_f", "_o")


def greedy_survivors(edges: DataFrame, heavy_rows: int | None = HEAVY_ROWS) -> DataFrame:
    """Survivors (_u, _f, _o) among distinct (_u, _f) pairs that carry their first place ``_o``.

    The first round takes the edges that come first at both ends; later rounds also settle the chains that hang on such edges, so
    an ordered chain of any length takes one round of a logarithmic number of joins.
    """
    remaining, survivors, rounds = cut_to_table(edges), None, 0
    while not remaining.isEmpty():
        ranked = _closest(_closest(remaining, "_u", "_first_u", heavy_rows), "_f", "_first_f", heavy_rows)
        if rounds:
            chosen = _along_chains(cut_to_table(ranked), heavy_rows)
        else:
            chosen = ranked.where((F.col("_o") == F.col("_first_u")) & (F.col("_o") == F.col("_first_f"))).select("_u", "_f", "_o")
        chosen, rounds = cut_to_table(chosen), rounds + 1
        survivors = chosen if survivors is None else survivors.unionByName(chosen)
        left = _taken(remaining, chosen, "_u", "_gone_u", heavy_rows).where("_gone_u is null").drop("_gone_u")
        left = _taken(left, chosen, "_f", "_gone_f", heavy_rows).where("_gone_f is null").drop("_gone_f")
        remaining = cut_to_table(left)
    return edges.limit(0) if survivors is None else survivors


def _numbered(edges: DataFrame, heavy_rows: int) -> DataFrame:
    """Edges written once with a number for their place, and each end named by the number of its first edge: the rounds then move
    three numbers instead of URLs, names and prints. Adds ``u``, ``f``, ``_o`` (number, row_id) and the edges at both ends."""
    placed = edges.repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_p", F.monotonically_increasing_id())
    placed = cut_to_table(placed.select("_u", "_f", "_members", F.struct("_p", "_o.row_id").alias("_o")))
    for end, name in (("_u", "u"), ("_f", "f")):
        groups = placed.groupBy(end).agg(F.min("_o._p").alias(name), F.count(F.lit(1)).alias(f"_n{name}"))
        placed = attach_group_values(placed, groups, [end], f"_n{name}", F.col("_o"), heavy_rows)
    return cut_to_table(placed)


def assign_survivors(promotions: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Adds ``survivor_id`` (the row_id a row merges into, its own for survivors) and the order ``_o``."""
    rows = _keyed(promotions)
    edges = _numbered(cut_to_table(rows.groupBy("_u", "_f").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_members"))), heavy_rows)
    most, most_rows = edges.agg(F.max(F.greatest("_nu", "_nf")), F.max("_members")).first()
    heavy = heavy_rows if (most or 0) >= heavy_rows else None  # edges only leave, so no round has a heavier end
    survivors = greedy_survivors(edges.select(F.col("u").alias("_u"), F.col("f").alias("_f"), "_o"), heavy)

    def by(end: str, name: str, base: DataFrame) -> DataFrame:
        """Edges with the place of the survivor at one end. Each end has one survivor at most."""
        return join_unique(base, survivors.select(F.col(f"_{end}").alias(end), F.col("_o").alias(name)), [end], F.col("_o"), heavy)

    targets = by("f", "_sf", by("u", "_su", edges)).select("_u", "_f", "_members", F.least("_su", "_sf").alias("_s"))
    out = attach_group_values(rows, targets, ["_u", "_f"], "_members", F.col("row_id"), heavy_rows if (most_rows or 0) >= heavy_rows else None)
    return out.withColumn("survivor_id", F.col("_s")["row_id"]).drop("_s", "_u", "_f", "_members")


def merge_duplicates(assigned: DataFrame) -> DataFrame:
    """One row per survivor: its own facts, the first known prices and coordinates of its members in
    order, their best precision and the best confidence with its explanation."""
    signals = F.coalesce(F.size("source_confidence_explanation.signals"), F.lit(0))
    best = F.min_by(
        F.struct("source_confidence", "source_confidence_explanation"),
        F.struct(-F.col("source_confidence"), -signals, F.col("_o")),
    )

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("_o"))).alias(name)

    precision = F.max(ordinal(F.col("location_precision"), V.LOCATION_PRECISION))
    own = [c for c in assigned.columns if c not in (
        "price_from", "price_to", "latitude", "longitude", "location_precision", "source_confidence",
        "source_confidence_explanation", "source_urls", "brochure_urls", "tags", "evidence", "survivor_id", "_o")]
    self_row = F.when(F.col("row_id") == F.col("survivor_id"), F.struct(*own))
    merged = assigned.groupBy("survivor_id").agg(
        F.first(self_row, ignorenulls=True).alias("_own"), best.alias("_best"),
        first("price_from"), first("price_to"), first("latitude"), first("longitude"),
        precision.alias("_precision"), F.count(F.lit(1)).alias("members"),
    )
    names = F.array(*[F.lit(n) for n in V.LOCATION_PRECISION])
    return merged.select(
        "_own.*", "price_from", "price_to", "latitude", "longitude",
        F.element_at(names, (F.col("_precision") + 1).cast("int")).alias("location_precision"),
        F.col("_best.source_confidence"), F.col("_best.source_confidence_explanation"), "members",
    )


def merged_values(assigned: DataFrame, column: str) -> DataFrame:
    """Distinct values of an array column over the members of each survivor, without blank ones, as rows (survivor_id, value).

    Rows, as a survivor may stand for a third of the table; ``merge_arrays`` puts them in order into one array. ``first_spelling``
    below is the case-blind form used for tags.
    """
    values = assigned.select("survivor_id", F.explode(column).alias("value"))
    return values.where(F.col("value").rlike(r"(?U)\S")).distinct()


def first_spelling(assigned: DataFrame, column: str) -> DataFrame:
    values = assigned.select("survivor_id", "_o", F.posexplode(column).alias("_p", "value"))
    return values.groupBy("survivor_id", F.lower("value").alias("_low")).agg(
        F.min_by("value", F.struct("_o", "_p")).alias("value")).drop("_low")


def merged_evidence(assigned: DataFrame) -> DataFrame:
    """Evidence of all members as rows, to be read in (field, source_url) order."""
    return assigned.select("survivor_id", F.inline("evidence"))


def merge_arrays(assigned: DataFrame) -> DataFrame:
    """One row per survivor with the whole lists of all its members: source URLs and brochures distinct and in order, tags distinct
    and in order whatever the case, and every piece of evidence in (field, source_url) order, equal ones as the members come.

    Values are made distinct with map-side combining before the lists are built, and all lists are built by one aggregate. Evidence
    is sorted in ranges and numbered there, so that a list under construction holds a number beside each piece and not its order.
    """
    tag = F.struct(F.upper("value").alias("_up"), "value").alias("_tag")
    place = ["survivor_id", "_e.field", "_e.source_url", "_o", "_p"]
    proof = assigned.select("survivor_id", "_o", F.posexplode("evidence").alias("_p", "_e")).repartitionByRange(*place).sortWithinPartitions(*place)
    parts = [
        assigned.where("row_id = survivor_id").select("survivor_id"),  # a survivor without values has empty lists
        merged_values(assigned, "source_urls").withColumnRenamed("value", "_url"),
        merged_values(assigned, "brochure_urls").withColumnRenamed("value", "_brochure"),
        first_spelling(assigned, "tags").select("survivor_id", tag),
        proof.select("survivor_id", F.struct(F.monotonically_increasing_id().alias("_at"), "_e").alias("_proof")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy("survivor_id").agg(
        F.array_sort(F.collect_list("_url")).alias("source_urls"),
        F.array_sort(F.collect_list("_brochure")).alias("brochure_urls"),
        F.transform(F.array_sort(F.collect_list("_tag")), lambda t: t["value"]).alias("tags"),
        F.transform(F.array_sort(F.collect_list("_proof")), lambda e: e["_e"]).alias("evidence"),
    )


def possible_duplicates(survivors: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Flag survivors after the first one of the same name and place; they stay separate."""
    rows = survivors.withColumns(
        {"_n_name": normalize_text(F.col("name")), "_n_place": normalize_text(F.col("municipality"))}
    )
    order = F.struct("canonical_url", "name", "row_id")
    groups = rows.groupBy("_n_name", "_n_place").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    out = attach_group_values(rows, groups, ["_n_name", "_n_place"], "_n", F.col("row_id"), heavy_rows)
    return out.withColumn("possible_duplicate", order > F.col("_first")).drop("_n_name", "_n_place", "_first", "_n")


def deduplicate(promotions: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Survivors with merged facts and the duplicate warning flag."""
    return possible_duplicates(merge_duplicates(assign_survivors(promotions, heavy_rows)), heavy_rows)


def distinct_on_page(promotions: DataFrame) -> DataFrame:
    """First listing per (url, name, prices), whatever the case; within a page (of a source) if there is a column ``_page``."""
    page = [F.col(c) for c in ("source_id", "_page") if "_page" in promotions.columns and c in promotions.columns]
    key = F.lower(F.concat_ws("\u001f", *page, "canonical_url", "name", F.coalesce(F.col("price_from").cast("string"), F.lit("")),
                              F.coalesce(F.col("price_to").cast("string"), F.lit(""))))
    columns = promotions.columns
    return (
        promotions.withColumn("_key", key)
        .groupBy("_key")
        .agg(F.min_by(F.struct(*columns), "row_id").alias("_row"))
        .select("_row.*")
    )
