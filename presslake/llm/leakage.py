"""Evaluation passages inside training text.

Edit distance between passages is mapped to Hamming distance by the CGK random
walk: a pointer walks over the words of a passage; every step emits the word
under it and a random bit of that word decides whether it moves on. Passages
within few edits agree in most of the emitted places. Each repetition uses its
own walk and samples some places; windows of the corpus whose sample equals
that of a window of an evaluation item are candidates, which exact word-level
edit distance then verifies.

Every run of ``window`` words of every item is a query, and the ``window`` words
from every place of every document on are looked up. A hit is verified against
the passages of ``window - edits`` to ``window + edits`` words that begin there,
so that inserted and deleted words count as edits too. The number of
repetitions follows from the wished recall and the collision rate of simulated
edits; without edits a passage's walk is the same on both sides, so that one
repetition finds all, and the sampled places only save work.

Up to MOST_CHARACTERS of evaluation text are broadcast, and each document is
looked up where it is read: a single narrow pass over the corpus without any
shuffle of texts, so a hot passage or source can't skew anything. Beyond that
size nothing of the items reaches the driver: their sampled keys become a table,
and the corpus windows whose key passes a bitmap of bounded size are joined with
it by key.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.session import StagedTable

_INLINE_TAG = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|ins|del|mark|q|s|small|span|strong|sub|sup|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORDS = re.compile(r"[^\W_]+")
#: Characters of evaluation text that are broadcast at most, and words of the corpus handled at once.
MOST_CHARACTERS, CHUNK_WORDS = 4_000_000, 100_000
#: Bits of the bitmap of sampled keys (16 MB).
KEY_BITS = 1 << 27


def words(text: str | None) -> list[str]:
    """The words of a text without case, form, markup and invisible characters; NULL has none.

    Inline tags vanish, so they may stand inside a word; other tags separate.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        text = unicodedata.normalize("NFKC", text.casefold())
        return _WORDS.findall(_INVISIBLE.sub("", text))
    return _WORDS.findall(text.lower())


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A different 64-bit hash of hashes for every seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class Walk:
    """One repetition: a random walk over ``window`` words and the sampled places of what it emits."""

    def __init__(self, window: int, repetition: int, sampled: int):
        random = np.random.default_rng(7919 * repetition + window)
        self.window, self.repetition = window, repetition
        # One place from each of equal stretches, up to where a walk has usually passed the last word.
        stretches = np.array_split(np.arange(2 * window if sampled < 2 * window else 3 * window), min(sampled, 3 * window))
        self.places = np.array([random.choice(x) for x in stretches])

    def keys(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """The sampled key of each window of ``hashes`` that begins at ``starts``; none goes beyond its text's end in ``ends``."""
        at = starts.copy()
        ends = starts + self.window if ends is None else np.minimum(starts + self.window, ends)
        keys = np.zeros(len(starts), np.uint64)
        padded = np.append(hashes, np.uint64(0))
        coins = _mix(_mix(padded, 2 * self.repetition + 1), 2 * self.repetition + 2)  # bit j decides step j
        places = set(self.places.tolist())
        for step in range(int(self.places[-1]) + 1):
            over = at >= ends
            place = np.where(over, len(hashes), at)
            if step in places:
                with np.errstate(over="ignore"):
                    keys = (keys ^ padded[place]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(32)
            move = ((coins[place] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
            at = at + (move & ~over)
        return keys


def within_edits(a: list[str], b: list[str], most: int) -> bool:
    """Is the word-level edit distance of two passages at most ``most``? Banded dynamic programming."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            row[j] = min(previous[j] + 1, row[j - 1] + 1, previous[j - 1] + (x != b[j - 1]))
        if min(row) > most:
            return False
        previous = row
    return previous[-1] <= most


def begins_within(words: list[str], at: int, end: int, item: list[str], most: int, i: int = 0) -> bool:
    """Are the words from ``at`` on, up to some place before ``end``, within ``most`` edits of ``item`` from ``i`` on?

    Equal words are always paired, which is optimal, and each edit is tried at the first difference.
    """
    while i < len(item) and at < end and item[i] == words[at]:
        i, at = i + 1, at + 1
    if len(item) - i <= most:
        return True
    if most == 0:
        return False
    if at < end and (begins_within(words, at + 1, end, item, most - 1, i + 1) or begins_within(words, at + 1, end, item, most - 1, i)):
        return True
    return begins_within(words, at, end, item, most - 1, i + 1)


def repetitions(window: int, edits: int, sampled: int, recall: float, trials: int = 2000) -> int:
    """How many repetitions find a window with ``edits`` random edits with probability ``recall``."""
    if edits == 0:
        return 1
    random = np.random.default_rng(11)
    base = random.integers(1, 2**63, size=(trials, window), dtype=np.uint64)
    edited = np.zeros_like(base)
    for t in range(trials):
        row = base[t].tolist()
        for _ in range(edits):
            kind, at = random.integers(3), int(random.integers(len(row)))
            fresh = int(random.integers(1, 2**63))
            row = row[:at] + ([fresh] if kind == 0 else [fresh, row[at]] if kind == 1 else []) + row[at + 1 :]
        edited[t] = (row + [int(x) for x in random.integers(1, 2**63, size=window)])[:window]
    starts = np.arange(trials) * window
    missed = np.ones(trials, bool)
    for n in range(1, 65):
        walk = Walk(window, n - 1, sampled)
        missed &= walk.keys(base.ravel(), starts) != walk.keys(edited.ravel(), starts)
        if missed.mean() <= 1 - recall:
            return n
    raise ValueError(f"64 repetitions don't reach a recall of {recall}; sample fewer places or allow fewer edits")


class _Queries:
    """The windows of a block of items, by sampled key and repetition."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, edits: int, walks: list[Walk]):
        self.window, self.edits, self.walks = window, edits, walks
        flat = [_hash(w) for _, ws in items for w in ws]
        self.hashes = np.array(flat, np.uint64)
        starts, owners, texts, offset = [], [], [], 0
        for item, ws in items:
            for i in range(len(ws) - window + 1):
                starts.append(offset + i)
                owners.append(item)
                texts.append(ws[i : i + window])
            offset += len(ws)
        self.owners, self.texts = owners, texts
        self.tables = []
        for walk in walks:
            keys = walk.keys(self.hashes, np.array(starts, np.int64))
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def matches(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, words: list[str]) -> set[tuple[int, int]]:
        """(owner, item) of the corpus passages that verify; ``ends`` has the end of the text of each start."""
        found: set[tuple[int, int]] = set()
        refused: set[tuple[int, int]] = set()
        for walk, (keys, order) in zip(self.walks, self.tables):
            own = walk.keys(hashes, starts, ends)
            left = np.searchsorted(keys, own, "left")
            hit = np.flatnonzero((left < len(keys)) & (keys[np.minimum(left, len(keys) - 1)] == own))
            right = np.searchsorted(keys, own[hit], "right")
            for start, end, l, r in zip(starts[hit].tolist(), ends[hit].tolist(), left[hit].tolist(), right.tolist()):
                for q in order[l:r].tolist():
                    pair = (int(owner[start]), self.owners[q])
                    if pair in found or (start, q) in refused:
                        continue
                    if begins_within(words, start, end, self.texts[q], self.edits):
                        found.add(pair)
                    else:
                        refused.add((start, q))
        return found


def _chunks(batch: pa.RecordBatch, window: int, edits: int) -> Iterator[tuple[list, list[list[str]]]]:
    """(keys, texts as words) of a batch, about CHUNK_WORDS at once. A long text goes in overlapping pieces, so that memory is bounded and no window is lost."""
    keys, texts, held = [], [], 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        ws = words(t.as_py())
        for at in range(0, max(1, len(ws) - window + edits + 1), CHUNK_WORDS):
            piece = ws[at : at + CHUNK_WORDS + window + edits - 1]
            if len(piece) < window - edits:
                continue
            keys.append(k)
            texts.append(piece)
            held += len(piece)
            if held >= CHUNK_WORDS:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


class _Hashed:
    """The words of some texts in a row, hashed, with the places where a window can begin."""

    def __init__(self, texts: list[list[str]], least: int, cache: dict[str, int]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.words = [w for t in texts for w in t]
        if len(cache) > 500_000:
            cache.clear()
        for w in set(self.words):
            if w not in cache:
                cache[w] = _hash(w)
        self.hashes = np.fromiter((cache[w] for w in self.words), np.uint64, len(self.words))
        ends = np.cumsum(sizes)
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        position = np.arange(len(self.words))
        self.starts = position[position + least <= ends[self.owner]]
        self.ends = ends[self.owner[self.starts]]


def _scan(batches: Iterator[pa.RecordBatch], queries: _Queries) -> Iterator[pa.RecordBatch]:
    window, edits = queries.window, queries.edits
    cache: dict[str, int] = {}
    for batch in batches:
        for keys, texts in _chunks(batch, window, edits):
            h = _Hashed(texts, window - edits, cache)
            found = {(keys[o], item) for o, item in queries.matches(h.hashes, h.starts, h.ends, h.owner, h.words)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["k", "i"])


def _windows(batches: Iterator[pa.RecordBatch], walks: list[Walk], least: int, length: int, passes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(owner, repetition, sampled key, words) of every window, or of those whose key is in the bitmap ``passes``."""
    window = walks[0].window
    cache: dict[str, int] = {}
    for batch in batches:
        for keys, texts in _chunks(batch, window, window - least):
            h = _Hashed(texts, least, cache)
            owners, numbers, samples, passages = [], [], [], []
            for walk in walks:
                own = walk.keys(h.hashes, h.starts, h.ends)
                at = np.arange(len(own))
                if passes is not None:
                    place = own % np.uint64(KEY_BITS)
                    at = np.flatnonzero((passes[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                for start, end, key in zip(h.starts[at].tolist(), h.ends[at].tolist(), own[at].astype(np.int64).tolist()):
                    owners.append(keys[h.owner[start]])
                    numbers.append(walk.repetition)
                    samples.append(key)
                    passages.append(" ".join(h.words[start : min(end, start + length)]))
                if len(owners) > 100_000:
                    yield _window_batch(owners, numbers, samples, passages)
                    owners, numbers, samples, passages = [], [], [], []
            if owners:
                yield _window_batch(owners, numbers, samples, passages)


def _window_batch(owners: list, numbers: list, samples: list, passages: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(numbers, pa.int32()), pa.array(samples, pa.int64()), pa.array(passages)], names=["o", "r", "key", "p"])


def _joined(corpus: DataFrame, items: DataFrame, window: int, edits: int, walks: list[Walk]) -> DataFrame:
    """(k, i) by a join of sampled keys, for evaluation text of any size."""
    spark = corpus.sparkSession
    schema = "o bigint, r int, key bigint, p string"
    asked = StagedTable(items.mapInArrow(lambda b: _windows(b, walks, window, window, None), schema).distinct())
    place = F.pmod(F.col("key"), F.lit(KEY_BITS))
    bits = asked.read().groupBy(F.floor(place / 64).cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(key, {KEY_BITS}L) % 64 as int)))").alias("b")).toArrow()
    passes = np.zeros(KEY_BITS // 64, np.uint64)
    passes[bits.column("w").to_numpy()] = bits.column("b").to_numpy().astype(np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(passes)
    met = corpus.mapInArrow(lambda b: _windows(b, walks, window - edits, window + edits, held.value), schema).distinct()

    @F.pandas_udf("boolean")
    def verifies(passage: pd.Series, item: pd.Series) -> pd.Series:
        def one(p: str, i: str) -> bool:
            ws = p.split(" ")
            return begins_within(ws, 0, len(ws), i.split(" "), edits)

        return pd.Series([one(p, i) for p, i in zip(passage, item)], dtype=bool)

    pairs = met.select(F.col("o").alias("k"), "r", "key", F.col("p").alias("passage")).join(asked.read().select(F.col("o").alias("i"), "r", "key", "p"), ["r", "key"])
    return pairs.filter(verifies("passage", "p")).select("k", "i")


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    window: int = 10,
    edits: int = 0,
    recall: float = 0.95,
    sampled: int = 5,
) -> DataFrame:
    """(doc_key, item_key): documents that hold ``window`` consecutive words of an item, with at most ``edits`` word edits.

    An edit replaces, inserts or deletes a word; the passage in the document has ``window - edits`` to ``window + edits`` words.
    Keys are integers. NULL texts and keys and items shorter than the window
    find nothing; repeated rows count once; other columns are ignored; empty
    tables give no row. Without edits the result is exact.
    """
    spark = documents.sparkSession
    n = repetitions(window, edits, sampled, recall)
    walks = [Walk(window, r, sampled) for r in range(n)]
    corpus = documents.select(F.col(doc_key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL")
    rows = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        found = _joined(corpus, rows, window, edits, walks)
    else:
        own = [(r.i, ws) for r in rows.orderBy("i", "t").collect() if len(ws := words(r.t)) >= window]
        held = spark.sparkContext.broadcast(_Queries(own, window, edits, walks))
        found = corpus.filter(F.lit(bool(own))).mapInArrow(lambda batches: _scan(batches, held.value), "k bigint, i bigint")
    return found.distinct().select(F.col("k").alias(doc_key), F.col("i").alias(item_key))


def brute_force(documents: pd.DataFrame, items: pd.DataFrame, window: int = 10, edits: int = 0) -> set[tuple[int, int]]:
    """All pairs of an item's windows and a document's passages of ``window - edits`` to ``window + edits`` words, for tests."""
    out = set()
    for item, text in items.itertuples(index=False):
        ws = words(text)
        own = [ws[i : i + window] for i in range(len(ws) - window + 1)]
        for doc, body in documents.itertuples(index=False):
            ds = words(body)
            if any(within_edits(ds[i : i + n], o, edits) for n in range(window - edits, window + edits + 1) for i in range(len(ds) - n + 1) for o in own):
                out.add((doc, item))
    return out
