"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression over the whole text. Words are runs of ``[^\\x20\\x09-\\x0D]``, lines are cut at ``\\n``.
Null text counts as a text without words. The result has one row per input row and no column of the input but its id,
so extra columns cannot clash; rows with a null or repeated id are rows like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of English, French, German and Spanish, counted in lower case and with a capital first letter.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with be by this from or an at not have but "
    "le la les de des du et en un une est que qui dans pour par sur au avec ne pas ce il "
    "der die das und den von zu mit sich dem ist im für auf als nicht ein eine auch es "
    "el los las y una por con su lo como más para del se no al"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= numerator / denominator <= high``; a ratio over nothing passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.10),
    Rule("exclamations_per_word", "n_exclamations", "n_words", high=0.30),
    Rule("capitals_per_char", "n_capitals", "word_chars", high=0.30),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.50),
)


def quality_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and the counts that the threshold table refers to, one row per input row, exact at any length.

    Repeated three-word windows are found per row: window hashes with the position in their low bits are sorted as
    plain longs, neighbours of one hash are candidates, and neighbours are compared by their words.
    """
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    split = base.select(
        "id", "body",
        F.expr(f"regexp_extract_all(body, r'{WORD}', 0)").alias("words"),
        F.expr(f"filter(split(body, '\\n', -1), x -> x rlike r'{WORD}')").alias("lines"),
    )
    keyed = split.withColumn("n", F.size("words")).withColumn("bits", F.expr("cast(length(bin(n)) as int)")).withColumn(
        "keys",
        F.expr("""sort_array(transform(sequence(0, greatest(n - 3, 0)), i -> coalesce(
            shiftleft(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), bits) | cast(i as bigint), 0L)))"""))
    near = keyed.withColumn("near", F.expr("""filter(sequence(1, greatest(n - 3, 1)),
        j -> shiftright(get(keys, j - 1) ^ get(keys, j), bits) = 0)""")).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    pairs = near.withColumn("pairs", F.expr("""transform(near, j -> named_struct(
        'p', cast(keys[j - 1] & mask as int), 'q', cast(keys[j] & mask as int)))"""))
    checked = pairs.withColumn("same", F.expr("""forall(pairs,
        x -> words[x.p] = words[x.q] and words[x.p + 1] = words[x.q + 1] and words[x.p + 2] = words[x.q + 2])"""))
    # two windows of one truncated hash: sort the candidates by their words
    ordered = checked.withColumn("starts", F.array_union("pairs.p", "pairs.q")).withColumn("ordered", F.expr("""if(same, null, sort_array(
        transform(starts, i -> named_struct('w', concat_ws(' ', words[i], words[i + 1], words[i + 2]), 'i', i))))"""))
    starts = ordered.withColumn("starts", F.expr("""if(same, starts, transform(
        filter(ordered, (x, j) -> get(ordered, j - 1).w = x.w or get(ordered, j + 1).w = x.w), x -> x.i))"""))
    stops = ", ".join(f"'{w}'" for word in STOP_WORDS for w in (word, word.capitalize()))
    return starts.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.concat("starts", F.transform("starts", lambda i: i + 1), F.transform("starts", lambda i: i + 2))))
        .cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("body", F.lit("!")).cast("long").alias("n_exclamations"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.expr(f"cast(size(filter(words, w -> w in ({stops}))) as bigint)").alias("n_stop_words"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the columns of ``quality_metrics``."""
    passes = F.lit(True)
    for rule in rules:
        top, under = F.col(rule.numerator), F.col(rule.denominator)
        if rule.low is not None:
            passes = passes & ((under == 0) | (top >= rule.low * under))
        if rule.high is not None:
            passes = passes & ((under == 0) | (top <= rule.high * under))
    return passes


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Id, the metrics, ``base_failed`` and ``kept`` for every row of ``df``.

    Empty and null texts have zero in every count, fail the base and are not kept. An empty table gives an empty result.
    """
    metrics = quality_metrics(df, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return metrics.withColumnRenamed("id", id_col).withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns; one projection, no join."""
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    judged = quality_rules(rows, "row", "body", rules)
    # a generator, since the optimizer would copy the whole projection into a pushed-down filter
    passed = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row")).where("row is not null")
    return passed.select("row.*").toDF(*df.columns)
