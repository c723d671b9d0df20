"""Term counts and cosines of batches of texts, for retrieval: functions for mapInArrow.

A text is its words, joined by single spaces; an empty word ends a passage, and
no sequence of words goes across it. Within a batch terms are numbers: a word is
its digest of 64 bits, a sequence of words is mixed of theirs. That two of n
terms share a number has a chance of n * n / 2^65 (one in 10^7 at two million).
Whatever the tasks need of the corpus and of the questions is read from tables
in the shared folder; the driver holds none of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

from folioforge.session import file_system

BYTES_AT_ONCE = 4_000_000  # of words
ENTRIES_AT_ONCE = 4_000_000  # of terms met with questions
PARTIAL = 1_000_000  # terms that a task adds up before it hands them on


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of a sequence from that of its beginning and that of its last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0x2545F4914F6CDD1D)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded bytes of words; a longer row stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["words"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, side="right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def term_rows(words: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, term, count): the distinct terms, and for each pair of a row and a term its row, place in terms and count."""
    lists = pc.split_pattern(words, " ")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    known = [w.as_py() for w in coded.dictionary]
    digests = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in known] or [0], dtype=np.uint64)
    real = np.array([w != "" for w in known] or [False])
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    one, good = digests[codes], real[codes]
    at, made, holds = [rows[good]], [one[good]], good
    sequence = one
    for n in range(2, longest + 1):
        sequence = _mixed(sequence[:-1], one[n - 1 :])
        holds = holds[:-1] & good[n - 1 :] & (rows[: -(n - 1)] == rows[n - 1 :])
        at.append(rows[: len(holds)][holds])
        made.append(sequence[holds])
    terms, place = np.unique(np.concatenate(made), return_inverse=True)
    pairs, count = np.unique(np.concatenate(at) * max(1, len(terms)) + place.reshape(-1), return_counts=True)
    return terms, pairs // max(1, len(terms)), pairs % max(1, len(terms)), count


def counted(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, df): texts that hold a term, added up as far as a task does."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        terms, place = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        df = np.bincount(place.reshape(-1), np.concatenate([d for _, d in held]), len(terms)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], ["term", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in _slices(batch):
                terms, _, term, _ = term_rows(part["words"], longest)
                held.append((terms, np.bincount(term, minlength=len(terms)).astype(np.int64)))
                if sum(len(t) for t, _ in held) > 4 * PARTIAL:
                    whole = added(held)
                    held = [(whole["term"].to_numpy().view(np.uint64), whole["df"].to_numpy())]
                    if len(held[0][0]) > PARTIAL:
                        yield whole
                        held = []
        if held:
            yield added(held)

    return run


def listed(longest: int, key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, term, n): how often each text holds each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                terms, row, term, count = term_rows(part["words"], longest)
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(row)).cast(key), pa.array(terms[term].view(np.int64)), pa.array(count.astype(np.int64))], ["key", "term", "n"])

    return run


def parts_of(path: str) -> Iterator[pa.Table]:
    """The row groups of a stored table, in the order of its files."""
    system, at = file_system(path)
    for info in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda i: i.base_name):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as opened:
                f = pq.ParquetFile(opened)
                for n in range(f.num_row_groups):
                    yield f.read_row_group(n)


class Index:
    """The frequencies of terms that two texts or more hold, and the questions: their terms, weights and scopes."""

    def __init__(self, frequent: str, asked: str) -> None:
        parts = [(t["term"].to_numpy(), t["df"].to_numpy().astype(np.int32)) for t in parts_of(frequent)]
        self.terms = np.concatenate([t for t, _ in parts] or [np.zeros(0, np.int64)])
        self.df = np.concatenate([d for _, d in parts] or [np.zeros(0, np.int32)])
        if (self.terms[1:] < self.terms[:-1]).any():
            order = np.argsort(self.terms)
            self.terms, self.df = self.terms[order], self.df[order]
        tables = list(parts_of(asked))
        self.any = bool(tables) and sum(t.num_rows for t in tables) > 0
        if not self.any:
            return
        table = pa.concat_tables(tables).combine_chunks()
        column = {c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in table.column_names}
        keys = column["q"].dictionary_encode()
        self.keys, q = keys.dictionary, keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.asked, a = np.unique(column["term"].to_numpy(zero_copy_only=False), return_inverse=True)
        a, w = a.reshape(-1), column["qw"].to_numpy(zero_copy_only=False)
        scopes = column["scope"].dictionary_encode()
        self.scopes = scopes.dictionary
        scope = pc.fill_null(scopes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        free = scope < 0
        # of each term the free questions that ask for it; of each scope its questions, of each of these its terms
        order = np.lexsort((q[free], a[free]))
        self.free_q, self.free_w = q[free][order], w[free][order]
        self.free_at = np.searchsorted(a[free][order], np.arange(len(self.asked) + 1))
        own = np.unique(scope[~free] * len(self.keys) + q[~free])
        self.scope_q = own % len(self.keys)
        self.scope_at = np.searchsorted(own // len(self.keys), np.arange(len(self.scopes) + 1))
        pair = q[~free] * len(self.asked) + a[~free]
        order = np.argsort(pair)
        self.pair, self.pair_w = pair[order], w[~free][order]

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """Texts that hold each term; what isn't listed is in one."""
        if not len(self.terms):
            return np.ones(len(terms))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.df[at], 1).astype(np.float64)


_INDEX: dict[tuple[str, str], Index] = {}


def _index(frequent: str, asked: str) -> Index:
    """The index of a run, kept for the next task of this process."""
    if (frequent, asked) not in _INDEX:
        _INDEX.clear()
        _INDEX[frequent, asked] = Index(frequent, asked)
    return _INDEX[frequent, asked]


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): of ranges each with its start and size, every place and the range it is in."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _blocks(row: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Slices of entries with bounded sizes in all, which don't part a row; entries are in the order of rows."""
    if not len(row):
        return
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
    done = np.cumsum(size)[ends - 1]
    at, k = 0, 0
    while k < len(ends):
        k = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + ENTRIES_AT_ONCE, side="right")))
        yield slice(at, int(ends[k - 1]))
        at = int(ends[k - 1])


def _summed(row: np.ndarray, q: np.ndarray, value: np.ndarray, questions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, q, dot): values added up."""
    if not len(row):
        return row, q, value
    low = int(row[0])
    key, cells = (row - low) * questions + q, (int(row[-1]) - low + 1) * questions
    if cells <= 4 * ENTRIES_AT_ONCE:
        sums = np.bincount(key, value, cells)
        key = np.flatnonzero(sums)
        sums = sums[key]
    else:
        key, place = np.unique(key, return_inverse=True)
        sums = np.bincount(place.reshape(-1), value, len(key))
    return key // questions + low, key % questions, sums


def _leading(q: np.ndarray, order_of: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Entries that may be among the first k of their question by score rounded to four places, then by order_of.

    The exact rounding is left to the caller: scores near the middle of two roundings are kept besides.
    """
    scaled = score * 1e4
    rounded = np.rint(scaled)
    doubtful = np.abs(np.abs(scaled - rounded) - 0.5) < 1e-6
    order = np.lexsort((order_of, -rounded, q))
    sorted_q = q[order]
    begins = np.flatnonzero(np.append(True, sorted_q[1:] != sorted_q[:-1]))
    run = np.cumsum(np.append(True, sorted_q[1:] != sorted_q[:-1])) - 1
    place = np.arange(len(order)) - begins[run]
    more = np.add.reduceat(doubtful[order].astype(np.int64), begins)[run]
    return order[(place < k + more) | doubtful[order]]


def scored(longest: int, k: int, n: int, least: float, frequent: str, asked: str, qtype: pa.DataType, ctype: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(q, key, score): of each batch the chunks that may be among the k best of a question; n: chunks in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(frequent, asked)
        for batch in batches:
            if not index.any:
                continue
            for part in _slices(batch):
                yield from best_of(part, index)

    def best_of(part: pa.RecordBatch, index: Index) -> Iterator[pa.RecordBatch]:
        terms, row, term, count = term_rows(part["words"], longest)
        if not len(terms):
            return
        signed = terms.view(np.int64)
        idf = np.log((1.0 + n) / (1.0 + index.frequencies(signed))) + 1
        tf = 1 + np.log(count)
        norm = np.sqrt(np.bincount(row, (tf * idf[term]) ** 2, part.num_rows))
        at = np.minimum(np.searchsorted(index.asked, signed), len(index.asked) - 1)
        at = np.where(index.asked[at] == signed, at, -1)[term]
        keyed = pc.is_valid(part["key"]).to_numpy(zero_copy_only=False)
        use = (at >= 0) & keyed[row]
        row, at, tf = row[use], at[use], tf[use]
        found = []
        size = index.free_at[at + 1] - index.free_at[at]
        for s in _blocks(row, size):
            which, place = _spread(index.free_at[at[s]], size[s])
            found.append(_summed(row[s][which], index.free_q[place], index.free_w[place] * tf[s][which], len(index.keys)))
        if len(index.scopes):
            scope = pc.fill_null(pc.index_in(part["scope"], value_set=index.scopes), -1).to_numpy(zero_copy_only=False)
            limited = scope[row] >= 0
            row, at, tf = row[limited], at[limited], tf[limited]
            scope = scope[row]
            size = index.scope_at[scope + 1] - index.scope_at[scope]
            for s in _blocks(row, size):
                which, place = _spread(index.scope_at[scope[s]], size[s])
                q = index.scope_q[place]
                pair = q * len(index.asked) + at[s][which]
                hit = np.minimum(np.searchsorted(index.pair, pair), len(index.pair) - 1)
                same = index.pair[hit] == pair
                found.append(_summed(row[s][which][same], q[same], index.pair_w[hit[same]] * tf[s][which][same], len(index.keys)))
        if not found:
            return
        row, q, dot = (np.concatenate(x) for x in zip(*found))
        score = dot / norm[row]
        some = score > least
        row, q, score = row[some], q[some], score[some]
        if not len(row):
            return
        rank = np.empty(part.num_rows, np.int64)
        rank[pc.sort_indices(part["key"]).to_numpy()] = np.arange(part.num_rows)
        kept = _leading(q, rank[row], score, k)
        yield pa.RecordBatch.from_arrays([index.keys.take(pa.array(q[kept])).cast(qtype), part["key"].take(pa.array(row[kept])).cast(ctype), pa.array(score[kept])], ["q", "key", "score"])

    return run
