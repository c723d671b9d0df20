"""Evaluation items that leaked into a corpus.

Words are compared without regard to case, accents, punctuation, markup, white
space, line-end division and encoding variants. One pass over the corpus counts
in how many documents each word of the items occurs and keeps, of each
document, the stretches dense enough in such words to hold a passage. An item
has two kinds of seeds. Its sequences of RUN words, by their hashes, find leaks
by run. The others are rare n-grams with gaps: N_GRAM of an item's rarest words,
by the counts over all documents, chosen among so many that every leak by share
holds at least N_GRAM of them. Only an item that a stretch shares such a seed
with is a candidate; it is kept while the words that both have in common
suffice, aligned by Smith-Waterman on words, and dropped where the score is too
little for any leak. The definition is then checked on the rest: at least RUN
words of the item in a row, or SHARE of its words in their order within a
stretch of at most STRETCH times its length.

The items are a stated set, sent in blocks of ITEMS_AT_ONCE. A block holds
arrays in proportion to its items' words (about forty bytes a word), no table of
items against words; the corpus is never joined with itself or collected.

Defined results: null and empty texts contain no item; items without words leak
nowhere; copies of a document give their own rows; a pair is given once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import stored

RUN, SHARE, STRETCH = 13, 0.8, 1.3
ITEMS_AT_ONCE = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
N_GRAM = 3  # words of a rare seed
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the hashes of word sequences

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_DIVIDED = re.compile("[-\N{HYPHEN}\N{NON-BREAKING HYPHEN}\N{SOFT HYPHEN}][ \\t]*[\\r\\n\N{LINE SEPARATOR}]\\s*")
_POINT = re.compile(r"[.,](?<=\d.)(?=\d)")
_MARKS = re.compile(r"[̀-ͯ҃-֑҇-ֽً-ٰٟ​-‏‪-‮⁠-⁤­﻿]+")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile("[ÃÂâÅÄ](?:[\x80-\xbf]|[^\x00-\xff]){1,3}")
_DROP = "-'’‘‐‑*_`~"


def _mended(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return m.group()


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out.append(text[at:a])
        at = b + 3
    return "".join(out) + text[at:]


def words_of(text: str | None) -> list[str]:
    """The words of a text in the form in which they are compared."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _without_comments(text))
    if not text.isascii():
        text = _BROKEN.sub(_mended, text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _DIVIDED.sub("", text)))
    elif "-" in text:
        text = _DIVIDED.sub("", text)
    for c in _DROP:
        if c in text:
            text = text.replace(c, "")
    return _WORD.findall(_POINT.sub("", text.casefold()))


def run_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each sequence of RUN words; equal sequences have equal hashes."""
    n = len(words) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    w = (words.astype(np.int64) + 2).astype(np.uint64)
    for i in range(RUN):
        out = out * BASE + w[i : i + n]
    return out


class Items:
    """A block of items, as numbers of their words, end to end."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.ids: list[int] = []
        self.code: dict[str, int] = {}
        words: list[np.ndarray] = []
        for item, text in rows:
            w = [self.code.setdefault(x, len(self.code)) for x in words_of(text)]
            if w:
                self.ids.append(item)
                words.append(np.array(w, np.int32))
        self.starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        hashes = [run_hashes(w) for w in words]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(h) for h in hashes])
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.runs, self.run_item = every[order], owner[order]
        first = np.arange(len(every)) - np.repeat(np.concatenate([[0], np.cumsum([len(h) for h in hashes])[:-1]]).astype(np.int64) if hashes else np.zeros(0, np.int64), [len(h) for h in hashes])
        self.run_at = (self.starts[owner] + first)[order].astype(np.int64)
        self.least = sorted({(need(len(w)), room(len(w))) for w in words})

    def __len__(self) -> int:
        return len(self.ids)

    def words(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k + 1]]

    def with_run(self, ids: np.ndarray) -> set[int]:
        """Items that share RUN words in a row with a document; equal hashes are compared word by word."""
        h = run_hashes(ids)
        ok = np.flatnonzero(np.convolve(ids >= 0, np.ones(RUN, np.int32), "valid") == RUN) if len(h) else h
        out: set[int] = set()
        if len(ok):
            lo, hi = np.searchsorted(self.runs, h[ok]), np.searchsorted(self.runs, h[ok], "right")
            for i, a, b in zip(ok[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                for x in range(a, b):
                    if int(self.run_item[x]) not in out and np.array_equal(self.flat[self.run_at[x] : self.run_at[x] + RUN], ids[i : i + RUN]):
                        out.add(int(self.run_item[x]))
        return out

    def dense(self, ids: np.ndarray) -> np.ndarray | None:
        """ids of the stretches that may hold a leak, parted by -1; None where there is none."""
        hit = ids >= 0
        n = len(hit)
        if not n or not len(self):
            return None
        total = np.concatenate([[0], np.cumsum(hit)])
        spread = np.zeros(n + 1, np.int32)
        found = False
        for least, size in [(RUN, RUN), *self.least]:
            size = min(size, n)
            start = np.flatnonzero(total[size:] - total[:-size] >= least)
            if len(start):
                found = True
                np.add.at(spread, start, 1)
                np.add.at(spread, start + size, -1)
        if not found:
            return None
        keep = np.cumsum(spread[:-1]) > 0
        edge = np.flatnonzero(keep[1:] != keep[:-1]) + 1
        parts = [p for p, k in zip(np.split(ids, edge), np.split(keep, edge)) if k[0]]
        gap = np.array([-1], np.int32)
        return np.concatenate([x for p in parts for x in (p, gap)]).astype(np.int32)


def need(length: int) -> int:
    return -int(-length * SHARE // 1)


def room(length: int) -> int:
    return int(length * STRETCH)


def seeds(words: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest places of an item, and how many of them every leak by share holds (N_GRAM, or all it needs).

    A leak may lack as many places as SHARE allows, so of that many and n more it holds n at least.
    """
    n = min(N_GRAM, need(len(words)))
    order = np.argsort(frequency[words], kind="stable")
    return order[: len(words) - need(len(words)) + n], n


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two word sequences."""
    best = 0
    row = np.zeros(len(b) + 1, np.int32)
    slope = np.arange(len(b) + 1, dtype=np.int32) * -GAP
    for x in a:
        score = np.where(b == x, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + score)
        new = np.maximum.accumulate(new + slope) - slope
        best = max(best, int(new.max()))
        row = new
    return best


def longest_common(positions: dict[int, int], full: int, window: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit; positions: word -> bits of its places in the item."""
    v = full
    for w in window:
        m = positions.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full.bit_length() - v.bit_count()


class Aligner:
    """Decides which items of a block a document contains."""

    def __init__(self, items: Items, frequency: np.ndarray) -> None:
        self.items = items
        n = len(items)
        self.least = np.array([need(int(b - a)) for a, b in zip(items.starts, items.starts[1:])], np.int64)
        self.seeds_needed = np.zeros(n, np.int64)
        seed_word, seed_item, bag_word, bag_count, bag_size = [], [], [], [], []
        for k in range(n):
            w = items.words(k)
            at, self.seeds_needed[k] = seeds(w, frequency)
            seed_word.append(w[at])
            seed_item.append(np.full(len(at), k, np.int32))
            held, often = np.unique(w, return_counts=True)
            bag_word.append(held)
            bag_count.append(often.astype(np.int32))
            bag_size.append(len(held))
        empty = np.zeros(0, np.int32)
        word, item = np.concatenate([*seed_word, empty]), np.concatenate([*seed_item, empty])
        order = np.argsort(word, kind="stable")
        self.seed_item = item[order]
        self.seed_start = np.searchsorted(word[order], np.arange(len(items.code) + 1))
        self.bag_word, self.bag_count = np.concatenate([*bag_word, empty]), np.concatenate([*bag_count, empty])
        self.bag_start = np.concatenate([[0], np.cumsum(bag_size)]).astype(np.int64)
        self.often = np.zeros(len(items.code), np.int32)  # of the document at hand
        self.places = lru_cache(4096)(self._places)

    def _places(self, k: int) -> dict[int, int]:
        at: dict[int, int] = {}
        for i, x in enumerate(self.items.words(k).tolist()):
            at[x] = at.get(x, 0) | 1 << i
        return at

    def candidates(self, held: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Items that a document shares a rare seed and words enough with."""
        counts = self.seed_start[held + 1] - self.seed_start[held]
        starts = np.repeat(self.seed_start[held] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        met, n = np.unique(self.seed_item[starts + np.arange(counts.sum())], return_counts=True)
        met = met[n >= self.seeds_needed[met]]
        if not len(met):
            return met
        # no alignment has more matches than there are common words
        self.often[held] = often
        sizes = self.bag_start[met + 1] - self.bag_start[met]
        edge = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.repeat(self.bag_start[met] - edge, sizes) + np.arange(sizes.sum())
        shared = np.add.reduceat(np.minimum(self.bag_count[at], self.often[self.bag_word[at]]), edge)
        self.often[held] = 0
        return met[shared >= self.least[met]]

    def found(self, ids: np.ndarray) -> set[int]:
        """Numbers of the items in a document's dense stretches."""
        out = self.items.with_run(ids)
        ok = ids >= 0
        held, often = np.unique(ids[ok], return_counts=True)
        if not len(held):
            return out
        for k in set(self.candidates(held, often).tolist()) - out:
            words = self.items.words(k)
            least, size = need(len(words)), room(len(words))
            inside = np.zeros(len(ids) + size, bool)  # a stretch may end where the document does
            inside[: len(ids)] = np.isin(ids, words)
            count = np.concatenate([[0], np.cumsum(inside)])
            start = np.flatnonzero((count[size:] - count[:-size] >= least) & inside[: len(ids) + 1])
            if not len(start):
                continue
            lo, hi = int(start[0]), int(start[-1]) + size
            if smith_waterman(words, ids[lo:hi]) < MATCH * least + GAP * (len(words) - least) + GAP * (size - least):
                continue
            full = (1 << len(words)) - 1
            listed = ids.tolist()
            if any(longest_common(self.places(k), full, listed[s : s + size]) >= least for s in start.tolist()):
                out.add(k)
        return out


def leaks(documents: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, item_key) of each document and each item that it contains."""
    spark = documents.sparkSession
    total = items.count()
    blocks = max(1, -(-total // ITEMS_AT_ONCE))
    part = F.pmod(F.xxhash64(F.col(item_key)), F.lit(blocks))
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    results = []
    for n in range(blocks):
        rows = [(r[0], r[1]) for r in items.filter(part == n).select(item_key, F.col(text).cast("string")).toLocalIterator()]
        block = spark.sparkContext.broadcast(Items(rows))

        def reduce_documents(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            it = block.value
            get, width = it.code.get, len(it.code)
            count = np.zeros(width, np.int64)
            names = [key, "words", "counts"]
            type_ = None
            for b in batches:
                type_ = b.schema.field(0).type
                take, out = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    w = words_of(t)
                    ids = np.array([get(x, -1) for x in w], np.int32)
                    count[np.unique(ids[ids >= 0])] += 1
                    d = it.dense(ids)
                    if d is not None:
                        take.append(i)
                        out.append(d)
                if take:
                    keys = b.column(0).take(pa.array(take, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.list_(pa.int32())), pa.nulls(len(take), pa.list_(pa.int64()))], names)
            if type_ is not None:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, type_), pa.nulls(1, pa.list_(pa.int32())), pa.array([count.tolist()], pa.list_(pa.int64()))], names)

        reduced = stored(
            documents.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(reduce_documents, f"`{key}` {kind}, words array<int>, counts array<bigint>"),
            "leak-stretches",
        )
        # a row for each word of the items, whatever the corpus
        sums = reduced.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("w", "n")).groupBy("w").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(len(block.value.code), np.int64)
        for r in sums:
            frequency[r["w"]] = r["n"]
        sent = spark.sparkContext.broadcast(frequency)

        def align(batches: Iterator[pa.RecordBatch], block=block, sent=sent) -> Iterator[pa.RecordBatch]:
            aligner = None
            for b in batches:
                aligner = aligner or Aligner(block.value, sent.value)
                take, hits = [], []
                offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
                for i in range(b.num_rows):
                    for k in sorted(aligner.found(flat[offsets[i] : offsets[i + 1]])):
                        take.append(i)
                        hits.append(aligner.items.ids[k])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(hits, pa.int64())], [key, item_key])

        found = reduced.filter("words IS NOT NULL").select(key, "words").mapInArrow(align, f"`{key}` {kind}, `{item_key}` bigint")
        results.append(found.withColumn(item_key, F.col(item_key).cast(item_kind)).distinct())
    return reduce(DataFrame.unionByName, results)
