"""Byte-level BPE encoding of a text column with a public vocabulary.

Pre-tokenisation is vectorised: each batch of texts becomes one array of code
points, then one of character classes (letter, number, other, white space,
space). The split rule is a finite transducer whose transition functions are
resets: whatever state it is in, a character's class fixes the next state. The
associative scan that composes such functions therefore collapses to its last
operand, and the start of every pre-token follows from the classes of a
character and its two neighbours; only an apostrophe that starts a contraction
looks two letters further. No regular expression runs over the texts.

The slices between starts go through a cache from slice to ids; slices that it
lacks are merged by rank. Each text keeps its pre-token offsets, so ids can be
traced back and decoded.

Defined results: null and empty texts give an empty list of ids; strings of
special tokens are ordinary text; repeated rows are encoded alike and kept.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER, LETTER, NUMBER, WHITE, SPACE, EDGE = range(6)
CHUNK_CHARS = 1 << 20  # code points handled at once
CACHE_SLICES = 1 << 20  # slices cached in a Python worker before the cache starts anew
#: Fixed value: the pattern that the vocabulary's merges are defined on; used for merging single slices only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_classes: np.ndarray | None = None
_merger: dict[bytes, Merger] = {}


def default_tokenizer_dir() -> str:
    return os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def character_classes() -> np.ndarray:
    """The class of every code point, built once in a process."""
    global _classes
    if _classes is None:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m.group()[0]), ord(m.group()[-1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[32] = SPACE
        _classes = table
    return _classes


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each code point whether a pre-token starts at it; first: whether a text does."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    c = character_classes()[points]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, c[:-1]
    before[first] = EDGE
    after = np.empty(n, np.uint8)
    after[-1] = EDGE
    after[:-1] = np.where(first[1:], EDGE, c[1:])
    white, white_before = c >= WHITE, (before == WHITE) | (before == SPACE)
    # a visible run starts where its class does, unless a space before it belongs to it
    visible = ~white & (before != c) & (before != SPACE)
    # white space: the run starts, and its last character stands apart when something visible follows
    blank = white & (~white_before | (after < WHITE))
    out = first | visible | blank
    # contractions
    at = np.flatnonzero((points == 39) & out)
    if len(at):
        pad = np.concatenate([points, np.zeros(3, points.dtype)])
        ends = np.concatenate([np.flatnonzero(first), [n]])
        limit = ends[np.searchsorted(ends, at, side="right")]
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [ord(x) for x in "stmd"]) & (at + 1 < limit)
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        long &= at + 2 < limit
        out[at[short | long] + 1] = False
        stop = np.concatenate([at[short] + 2, at[long] + 3])
        out[stop[stop < n]] = True
    return out


class Merger:
    """Ids of single pre-tokens, cached."""

    def __init__(self, rank_file: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.piece = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids: list[int] = []
        self.at: list[int] = [0]

    def new(self, piece: str) -> int:
        self.ids.extend(self.piece(piece))
        self.at.append(len(self.ids))
        self.code[piece] = code = len(self.at) - 2
        return code

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids before each text, slice starts in code points of each text, slices before each text) of some texts."""
        if len(self.code) > CACHE_SLICES:
            self.clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        base = np.concatenate([[0], np.cumsum(sizes)])
        first[base[:-1][sizes > 0]] = True
        cut = np.flatnonzero(starts(points, first))
        code, new = self.code, self.new
        bounds = [*cut.tolist(), len(points)]
        found = [code[s] if (s := joined[a:b]) in code else new(s) for a, b in zip(bounds, bounds[1:])]
        of = np.array(found, np.int64)
        at = np.array(self.at, np.int64)
        length = at[of + 1] - at[of] if len(of) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(length)])
        flat = np.array(self.ids, np.int32)
        place = np.arange(total[-1]) - np.repeat(total[:-1], length) + np.repeat(at[of] if len(of) else of, length)
        slices = np.searchsorted(cut, base)
        return flat[place], total[slices], cut - np.repeat(base[:-1], np.diff(slices)), slices


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = "byte_bpe_50k", directory: str | None = None, offsets: bool = False) -> DataFrame:
    """(key, ids) of each row; with offsets also starts, the 0-based code point at which each pre-token starts.

    The rank file (under 1 MB, whatever the corpus) is read by the driver and sent to every executor.
    """
    with open(os.path.join(directory or default_tokenizer_dir(), f"{tokenizer}.tiktoken"), "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = hashlib.sha256(ranks.value).digest()
        merger = _merger.get(source)
        if merger is None:
            _merger.clear()
            _merger[source] = merger = Merger(ranks.value)
        for b in batches:
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, room = i, CHUNK_CHARS
                while j < len(texts) and (room > 0 or j == i):
                    room -= len(texts[j])
                    j += 1
                ids, before, cut, slices = merger.encode(texts[i:j])
                out = [keys.slice(i, j - i), pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    out.append(pa.ListArray.from_arrays(pa.array(slices, pa.int32()), pa.array(cut, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [key, "ids", "starts"][: len(out)])
                i = j

    schema = f"`{key}` {kind}, ids array<int>" + (", starts array<int>" if offsets else "")
    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decode(ids: list[int], rank_file: bytes) -> str:
    """The text of some ids."""
    back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, rank_file.splitlines()) if a}
    return b"".join(back[i] for i in ids).decode("utf-8")
