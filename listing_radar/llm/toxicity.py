"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed words, adjacent pairs, and pairs with one or two words between them, each counted once. Words
are runs of letters, digits and characters beyond ASCII, with A-Z folded; whole texts are read. Training shards fit one model
each with per-coordinate rates and an L1 term, and the shards' weights are averaged. What is left after the L1 term is a sparse
weight table of bounded size, which is broadcast to the scoring tasks.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from listing_radar.llm import flat
from listing_radar.llm.storage import bound_batches

U = np.uint64


@dataclass(frozen=True)
class Ftrl:
    """Settings of the model; ``training_rows`` bounds the labelled rows used (chosen by hash of the id), in expectation.

    The number of shards depends on rows only. A shard keeps ``shard_bytes`` of features in memory, the rest in a temporary file.
    """

    bits: int = 22
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 1.0
    epochs: int = 6
    training_rows: int = 40_000
    shard_rows: int = 20_000
    shard_bytes: int = 96 << 20


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts (with repeats) and the number of the text each belongs to."""
    starts, ends, firsts = flat.words(data, offsets, flat.LETTERS)
    h = flat.word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(firsts))
    found, owners = [h], [owner]
    for gap in (1, 2, 3):
        if len(h) <= gap:
            break
        same = owner[gap:] == owner[:-gap]
        found.append((flat.mix(h[:-gap] * U(2 * gap + 1)) + h[gap:] * U(0xD6E8FEB86659FD93))[same])
        owners.append(owner[gap:][same])
    return (flat.mix(np.concatenate(found)) >> U(64 - bits)).astype(np.int64), np.concatenate(owners)


class FeatureRows:
    """Feature numbers per text, in memory up to ``limit`` bytes; those of later texts wait in a file without a name."""

    def __init__(self, limit: int):
        self.limit, self.held, self.rows, self.file, self.end = limit, 0, [], None, 0

    def append(self, row: np.ndarray) -> None:
        if self.held + row.nbytes <= self.limit:
            self.held += row.nbytes
            self.rows.append(row)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.write(row)
        self.rows.append((self.end, row.nbytes))
        self.end += row.nbytes

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[np.ndarray]:
        for row in self.rows:
            if isinstance(row, tuple):
                self.file.seek(row[0])
                row = np.frombuffer(self.file.read(row[1]), dtype=np.int32)
            yield row

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def train(rows: Iterable[np.ndarray], labels: np.ndarray, s: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the weights that are not zero; number 2**bits is the bias, which has no L1 term."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = 0.0
    for _ in range(s.epochs):
        for at, y in zip(rows, labels, strict=True):
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= s.l1, 0.0, (np.sign(za) * s.l1 - za) / ((s.beta + root) / s.alpha + s.l2))
            wb = -zb / ((s.beta + nb**0.5) / s.alpha + s.l2)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -30, 30))) - y
            n[at] = na + g * g
            z[at] = za + g - (np.sqrt(na + g * g) - root) / s.alpha * w
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / s.alpha * wb, nb + g * g
    w = np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    at = np.flatnonzero(w)
    return np.append(at, 1 << s.bits), np.append(w[at], -zb / ((s.beta + nb**0.5) / s.alpha + s.l2))


def _train_shard(batches, s: Ftrl):
    """Rows (shard, label, body), a shard's rows together; features beyond the settings' bytes wait on disk."""
    current, rows, labels = None, FeatureRows(s.shard_bytes), []

    def model():
        at, w = train(rows, np.array(labels, dtype=float), s)
        rows.close()
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["feature", "weight"])

    for batch in batches:
        data, offsets = flat.texts(batch.column(2))
        shards, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in flat.slices(offsets):
            found, owner = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], s.bits)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(hi - lo + 1))
            for i in range(hi - lo):
                if shards[lo + i] != current and labels:
                    yield model()
                    rows, labels = FeatureRows(s.shard_bytes), []
                current = shards[lo + i]
                rows.append(np.unique(found[order[bounds[i] : bounds[i + 1]]]).astype(np.int32))
                labels.append(ys[lo + i])
    if labels:
        yield model()


def fit_toxicity(labelled: DataFrame, s: Ftrl = Ftrl()) -> dict[int, float]:
    """Weights from rows (id, body, label); null labels are left out. The number 2**bits is the bias.

    Rows of one text and label train like any others. Without rows the model is empty and scores one half.
    """
    rows = labelled.where("label is not null").select("id", F.coalesce("body", F.lit("")).alias("body"), F.col("label").cast("int").alias("label"))
    n = rows.count()
    if not n:
        return {}
    shards = -(-n // s.shard_rows)
    order = F.xxhash64("id", "label", F.lit(11))
    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int").alias("shard"), "label", "body", order.alias("o"))
    dealt = dealt.repartition(int(shards), "shard").sortWithinPartitions("shard", "o", "body").select("shard", "label", "body")
    weights = dealt.mapInArrow(functools.partial(_train_shard, s=s), "feature long, weight double")
    mean = weights.groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))
    return {r.feature: r.weight for r in mean.collect()}  # at most 2**bits + 1 rows


def _score_rows(batches, weights, bits: int):
    numbers, values = weights.value
    table = np.zeros((1 << bits) + 1)
    table[numbers] = values
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        for lo, hi in flat.slices(offsets):
            found, owner = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
            hit = table[found] != 0
            seen = np.unique(owner[hit].astype(np.int64) << bits | found[hit])
            total = np.bincount(seen >> bits, weights=table[seen & ((1 << bits) - 1)], minlength=hi - lo) + table[-1]
            score = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
            rest = [batch.column(k).slice(lo, hi - lo) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), *rest], names=["id", "score", *batch.schema.names[2:]])


def score_toxicity(docs: DataFrame, model: dict[int, float], bits: int = Ftrl.bits) -> DataFrame:
    """(id, score) for every row (id, body); further columns of ``docs`` are handed through. Null counts as empty."""
    bound_batches(docs.sparkSession)
    sparse = np.array(list(model), dtype=np.int64), np.array(list(model.values()), dtype=np.float64)
    weights = docs.sparkSession.sparkContext.broadcast(sparse)
    schema = StructType([docs.schema["id"], StructField("score", DoubleType()), *docs.schema.fields[2:]])
    return docs.mapInArrow(functools.partial(_score_rows, weights=weights, bits=bits), schema)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Ftrl = Ftrl()) -> DataFrame:
    """Id, held_out, score and predicted for every row of ``df``.

    Only rows whose crc32 of the id, written as text, has a remainder other than 0 by 5 are learnt from; a null id is held
    out. Labels and ids never enter a score. Empty and null texts get the score of the bias. Repeated labels of one id count
    once, as the largest. Other columns of both tables are not looked at.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    model = learn_toxicity(docs, labels, id_col, label_col, s)
    return score_toxicity(docs, model, s.bits).select(
        F.col("id").alias(id_col), F.coalesce(_remainder() == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _remainder() -> Column:
    return F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5))


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", s: Ftrl = Ftrl()) -> dict[int, float]:
    """The model from the labelled rows of ``docs`` (id, body) that are not held out."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label is not null and id is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).where(_remainder() != 0)
    share = min(1.0, s.training_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return fit_toxicity(docs.join(F.broadcast(chosen), "id"), s)  # about training_rows ids of a few bytes


def fold_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Ftrl = Ftrl()) -> DataFrame:
    """(id, score, label) of every labelled row that is not held out, scored by a model that has not learnt from its fold.

    The folds are the remainders 1 to 4. Settings are compared with these rows, so held-out labels decide nothing. Null labels and
    ids are left out; repeated labels of one id count once, as the largest.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null and id is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("fold", _remainder()).where("fold <> 0")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    out = []
    for fold in range(1, 5):
        model = learn_toxicity(docs, known.where(F.col("fold") != fold), "id", "label", s)
        out.append(score_toxicity(docs.join(known.where(F.col("fold") == fold), "id").select("id", "body", "label"), model, s.bits))
    return functools.reduce(DataFrame.unionByName, out).withColumnRenamed("id", id_col)


def reject_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``df`` that score below one half, with all their columns."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), F.struct(*_columns(df)).alias("row"))
    model = learn_toxicity(docs.select("id", "body"), labels, id_col, label_col, s)
    return score_toxicity(docs, model, s.bits).where("score < 0.5").select("row.*").toDF(*df.columns)


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
