"""BPE encoding and decoding in batched numpy merge rounds.

The vocabulary file describes a byte-level BPE with word ends, whose texts are normalized (NFC, lower case) and cut into words by
a pattern; white space is dropped. A slice of texts is cut at white space, and its distinct chunks are found by hash and byte. What a
worker has not met before is cut into words, and each new word is encoded once: the symbols of all new words stand in one flat array,
every round looks up the ranks of all neighbouring pairs by binary search over the sorted pair keys, and merges each word's
lowest-ranked pair at all its places. That equals merging one pair at a time as long as no merge makes a pair of a lower rank; the
vocabulary is checked for it, otherwise one place per word and round is merged.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from listing_radar.llm import flat
from listing_radar.llm.flat import U
from listing_radar.llm.storage import bound_batches

#: White space as the vocabulary's patterns mean it. str.split() also cuts at 1C-1F, which are symbols here.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}" + _SPACE[1:-1] + "]+")
#: The words of chunks joined by line breaks; a line break is a word of its own here.
_WORDS = regex.compile(_WORD.pattern + r"|\n")
#: A worker keeps two generations of chunks and words; when the younger one reaches this many bytes, the older one is dropped.
GENERATION_BYTES = 96 << 20
#: What an entry takes beyond its own bytes, and what one of its ids takes.
ENTRY_BYTES, ID_BYTES = 150, 4


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Bpe:
    """A vocabulary with its pair tables and the chunks encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in described["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in described["added_tokens"]}
        self.special_cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))).encode()) if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b.removesuffix(end) + end if b.endswith(end) and end else a + b]) for a, b in merges], strict=True))
        order = np.argsort(left << 32 | right, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = (left << 32 | right)[order], order, made
        first_use: dict[int, int] = {}
        for rank, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            first_use.setdefault(a, rank)
            first_use.setdefault(b, rank)
        self.ordered = all(first_use.get(m, len(merges)) > rank for rank, m in enumerate(made.tolist()))
        self.clear()

    def clear(self) -> None:
        self.chunks, self.words = (_Chunks(), _Chunks()), (_Words(), _Words())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.made))

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and their bounds."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids, owner = self.inner[data], np.repeat(np.arange(len(words)), lengths)
        ids[np.cumsum(lengths) - 1] = self.final[data[np.cumsum(lengths) - 1]]
        done_ids, done_owner, none = [], [], len(self.made)
        last = np.append(owner[1:] != owner[:-1], True)  # no pair begins at a word's last symbol
        rank = np.full(len(ids), none, dtype=np.int64)
        pair = np.flatnonzero(~last)
        rank[pair] = self.ranks(ids[pair], ids[pair + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, last[:-1]))
            lengths = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            if (least == none).any():
                going_on = np.repeat(least < none, lengths)
                done_ids.append(ids[~going_on])
                done_owner.append(owner[~going_on])
                ids, owner, rank, last = ids[going_on], owner[going_on], rank[going_on], last[going_on]
                lengths, least = lengths[least < none], least[least < none]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            if self.ordered:  # of overlapping places every second one of a run, from the left
                run_start = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
                places = np.arange(len(at))
                at = at[(places - np.maximum.accumulate(np.where(run_start, places, 0))) % 2 == 0]
            else:
                at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            ids[at], last[at] = self.made[rank[at]], last[at + 1]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            ids, owner, rank, last = ids[stay], owner[stay], rank[stay], last[stay]
            made = at - np.arange(len(at))  # only pairs with a new symbol have a new rank
            before = made[made > 0] - 1
            pair = np.concatenate([made, before[~last[before]]])
            rank[made] = none
            pair = pair[~last[pair]]
            rank[pair] = self.ranks(ids[pair], ids[pair + 1])
        if done_ids:
            ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids, np.searchsorted(owner, np.arange(len(words) + 1))

    def _ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in one array, and their bounds; each word that no generation holds is merged once. A line break has none."""
        young, old = self.words
        at = np.fromiter(map(young.__getitem__, words), dtype=np.int64, count=len(words))
        if young.new:
            known = [w for w in young.new if w in old]
            new = [w for w in young.new if w not in old] if known else young.new
            ids, bounds = self.merge_words([w.encode() for w in new]) if new else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            if known:  # in the order of their numbers
                more, upto = take_runs(old.ids, old.bounds, np.fromiter(map(old.__getitem__, known), dtype=np.int64, count=len(known)))
                which = np.fromiter((w in old for w in young.new), dtype=bool, count=len(young.new))
                order = np.empty(len(which), dtype=np.int64)
                order[~which], order[which] = np.arange(len(new)), len(new) + np.arange(len(known))
                ids, bounds = take_runs(np.concatenate([ids, more.astype(np.int64)]), np.concatenate([bounds, bounds[-1] + upto[1:]]), order)
            young.learn(ids, bounds)
        return take_runs(young.ids, young.bounds, at)

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks that no generation holds, in one array, and their bounds."""
        text = b"\n".join(chunks).decode("utf-8", "replace")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        words = _WORDS.findall(text.lower())
        ids, bounds = self._ids_of_words(words)
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, words), dtype=bool, count=len(words)))
        return ids, bounds[np.concatenate([[0], breaks, [len(words)]])]

    def encode_chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, given by their bytes, in one array, and their bounds."""
        if self.chunks[0].size + self.words[0].size > GENERATION_BYTES:
            self.chunks, self.words = (_Chunks(), self.chunks[0]), (_Words(), self.words[0])
        starts, ends, firsts = flat.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, first, number = distinct_runs(data, starts, ends)
        starts, ends = starts[first], ends[first]
        young, old = self.chunks
        at = young.find(hashes, data, starts, ends)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            before = old.find(hashes[missing], data, starts[missing], ends[missing])
            known, new = missing[before >= 0], missing[before < 0]
            ids, bounds = take_runs(old.ids, old.bounds, before[before >= 0])
            if len(new):
                raw = data.tobytes()
                more, upto = self._learn([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
                ids, bounds = np.concatenate([ids, more]), np.concatenate([bounds, bounds[-1] + upto[1:]])
            some = np.concatenate([known, new])
            at[some] = young.add(hashes[some], at[some] == ABSENT, data, starts[some], ends[some], ids, bounds)
        ids, bounds = take_runs(young.ids, young.bounds, at[number])
        return ids, bounds[firsts]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bit) of all texts in one array, and their bounds. Special tokens in a text are found before all else."""
        raw = data.tobytes()
        met = [m for m in self.special_cut.finditer(raw) if m.end() <= offsets[np.searchsorted(offsets, m.start(), side="right")]] if self.special_cut and b"<|" in raw else []
        if not met:
            return self.encode_chunks(data, offsets)
        data = data.copy()
        for m in met:
            data[m.start() : m.end()] = 32  # blank, at the head of the piece that begins here
        at = np.array([m.start() for m in met], dtype=np.int64)
        pieces = np.sort(np.concatenate([offsets, at]), kind="stable")
        ids, bounds = self.encode_chunks(data, pieces)
        place = np.searchsorted(pieces, at, side="right") - 1  # the piece that begins at each special token
        ids = np.insert(ids, bounds[place], np.array([self.special[m[0].decode()] for m in met], dtype=np.uint32))
        more = np.zeros(len(bounds), dtype=np.int64)
        np.add.at(more, place + 1, 1)
        return ids, (bounds + np.cumsum(more))[np.searchsorted(pieces, offsets, side="left")]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_bytes`` for a list of texts; null is empty."""
        return self.encode_bytes(*flat.texts(pa.array(texts, pa.string())))

    @functools.cached_property
    def _pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = max(self.tokens) + 1
        coded = [(" " + self.tokens.get(i, "")).encode() if i in self.tokens else b"" for i in range(size)]
        lengths = np.array([len(c) for c in coded], dtype=np.int64)
        return np.frombuffer(b"".join(coded), dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all decoded texts, tokens joined by blanks, and their bounds. Without a decoder part that is the whole rule."""
        data, starts, lengths = self._pieces
        n = lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = data[np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[ids], n)]
        keep = np.ones(len(out), dtype=bool)
        first = bounds[:-1][np.diff(bounds) > 0]
        keep[ends[first]] = False  # no blank before the first token of a text
        return out[keep], ends[bounds] - np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])


def take_runs(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered ``at`` of ``values`` in one array, and their bounds."""
    starts = bounds[at]
    lengths = bounds[at + 1] - starts
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, lengths)], ends


class _Words(dict):
    """Words of one generation with their ids; a new word gets the next number and waits in ``new``. The line break is number 0."""

    def __init__(self):
        super().__init__({"\n": 0})
        self.ids, self.bounds, self.new, self.size = np.zeros(0, np.uint32), np.zeros(2, np.int64), [], 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def learn(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Ids of the words in ``new``."""
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        self.size += sum(map(len, self.new)) + ENTRY_BYTES * len(self.new) + ID_BYTES * len(ids)
        self.new = []


ABSENT, OTHER = -1, -2


class _Chunks:
    """Chunks of one generation with their ids, in arrays: a hash table whose hits are compared byte by byte."""

    def __init__(self):
        self.hashes, self.places, self.used = np.zeros(1 << 14, dtype=np.uint64), np.zeros(1 << 14, dtype=np.int64), 0
        self.data, self.offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.places, self.data, self.offsets, self.ids, self.bounds))

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of chunks, ABSENT for new ones, OTHER for those whose hash belongs to another chunk."""
        mask, at = len(self.hashes) - 1, np.full(len(hashes), ABSENT, dtype=np.int64)
        going_on, slot = np.arange(len(hashes)), (hashes & U(len(self.hashes) - 1)).astype(np.int64)
        while len(going_on):
            there = self.hashes[slot]
            hit = there == hashes[going_on]
            at[going_on[hit]] = self.places[slot[hit]]
            more = ~hit & (there != 0)
            going_on, slot = going_on[more], slot[more] + 1 & mask
        met = np.flatnonzero(at >= 0)
        kept, upto = take_runs(self.data, self.offsets, at[met])
        same = np.diff(upto) == ends[met] - starts[met]
        if not same.all():
            kept, upto = take_runs(self.data, self.offsets, at[met[same]])
        own = take_runs(data, np.stack([starts[met[same]], ends[met[same]]], axis=1).ravel(), 2 * np.arange(same.sum()))[0]
        unequal = np.add.reduceat((kept != own).astype(np.int64), upto[:-1]) if len(own) else np.zeros(0, np.int64)
        at[met[~same]] = OTHER
        at[met[same][unequal > 0]] = OTHER
        return at

    def add(self, hashes: np.ndarray, filed: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Take in chunks with their ids and return their numbers; only those ``filed`` can be found later."""
        numbers = len(self.bounds) - 1 + np.arange(len(hashes))
        own, upto = take_runs(data, np.stack([starts, ends], axis=1).ravel(), 2 * np.arange(len(starts)))
        self.data, self.offsets = np.concatenate([self.data, own]), np.concatenate([self.offsets, self.offsets[-1] + upto[1:]])
        self.ids, self.bounds = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        if 2 * (self.used + len(hashes)) > len(self.hashes):
            taken = self.hashes != 0
            held = self.hashes[taken], self.places[taken]
            size = 1 << int(4 * (self.used + len(hashes))).bit_length()
            self.hashes, self.places, self.used = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64), 0
            self._file(*held)
        self._file(hashes[filed], numbers[filed])
        return numbers

    def _file(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Enter distinct hashes that are not in the table."""
        mask = len(self.hashes) - 1
        self.used += len(hashes)
        slot = (hashes & U(mask)).astype(np.int64)
        while len(hashes):
            free = self.hashes[slot] == 0
            self.hashes[slot[free]] = hashes[free]  # of several the last one stays
            done = free & (self.hashes[slot] == hashes)
            self.places[slot[done]] = numbers[done]
            hashes, numbers, slot = hashes[~done], numbers[~done], slot[~done] + 1 & mask


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct byte ranges: the hash (not 0) and place of one range of each, and for every range the number of its like."""
    hashes = np.maximum(flat.word_hashes(data, starts, ends, fold=False), U(1))
    kinds, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, like = ends - starts, first[number]
    if (lengths == lengths[like]).all():
        repeated = np.flatnonzero(like != np.arange(len(starts)))
        pairs = np.stack([starts, ends], axis=1).ravel()
        if (take_runs(data, pairs, 2 * repeated)[0] == take_runs(data, pairs, 2 * like[repeated])[0]).all():
            return kinds, first, number
    raw, met = data.tobytes(), {}  # ranges that differ have one hash
    number = np.array([met.setdefault(raw[a:b], len(met)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    first = np.unique(number, return_index=True)[1]
    return hashes[first], first, number


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file with the job; returns the name under which tasks find it."""
    name = path.rsplit("/", 1)[-1]
    if name not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


@functools.lru_cache(maxsize=2)
def load_shipped(name: str) -> Bpe:
    """The vocabulary in a task, kept for all tasks of a worker."""
    return Bpe(SparkFiles.get(name))


def encoded_slices(batches, name: str):
    """(batch, lo, hi, ids, bounds) for bounded row ranges of batches whose second column is the text."""
    bpe = load_shipped(name)
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        for lo, hi in flat.slices(offsets):
            yield batch, lo, hi, *bpe.encode_bytes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _digest_rows(batches, name: str):
    bpe = load_shipped(name)
    for batch, lo, hi, ids, bounds in encoded_slices(batches, name):
        raw, (decoded, ends) = memoryview(ids.astype("<u4")).cast("B"), bpe.decode(ids, bounds)
        decoded = memoryview(decoded)
        yield pa.RecordBatch.from_arrays([
            batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)),
            pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
            pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)])],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _id_rows(batches, name: str):
    for batch, lo, hi, ids, bounds in encoded_slices(batches, name):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64)))], names=["id", "ids"])


def _text_rows(batches, name: str):
    bpe = load_shipped(name)
    for batch in batches:
        lists = [np.array([x for x in row or [] if x is not None], dtype=np.int64) for row in batch.column(1).to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        data, ends = bpe.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), bounds)
        data = data.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)])], names=["id", "text"])


def _mapped(df: DataFrame, function, id_col: str, col: str, path: str, schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    rows = df.selectExpr(f"`{id_col}` as id", f"`{col}` as body")
    return rows.mapInArrow(functools.partial(function, name=ship_vocabulary(df.sparkSession, path)), f"id {dict(rows.dtypes)['id']}, {schema}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>) of every row; null and empty texts have no ids. One row per input row, other columns are not looked at."""
    return _mapped(df, _id_rows, id_col, text_col, path, "ids array<bigint>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null lists and null entries count as absent, ids outside the vocabulary fail."""
    return _mapped(df, _text_rows, id_col, ids_col, path, "text string")


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: each text encoded whole and decoded again."""
    return _mapped(df, _digest_rows, id_col, text_col, path, "n_tokens long, ids_sha256 string, decoded_sha256 string")
