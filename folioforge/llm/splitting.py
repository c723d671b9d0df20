"""Splitting of oversized texts at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint;
halves that still exceed the limit minus the overlap are cut again. Then every
piece but the first is prolonged to the left by up to the overlap, back to the
start of a word, so consecutive pieces share that stretch.

Boundaries by strength: blank line, line end, sentence end, clause mark, white
space, between characters (never before a combining mark or inside a joined
sequence). "Near" is the middle half of the stretch to cut; a weaker boundary
there is preferred to a stronger one outside.

Defined results: null, blank and short texts give one piece (their own text
without outer white space; null stays null); token_count is the number of
white-space separated words; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 350, 60

#: Fixed value: the characters with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

_BOUNDARY = re.compile(
    r"(?P<a>\r?\n[ \t]*\r?\n\s*)|(?P<b>[\r\n]\s*)|(?P<c>[.!?…।۔؟]+[\"'”’)\]»]*\s+|[。！？]+[」”）]*)"
    r"|(?P<d>[,;:،、，；：]\s+|[、，；：]|\s[-–—|]\s+)|(?P<e>\s+)"
)
_STRENGTH = {"a": 5, "b": 4, "c": 3, "d": 2, "e": 1}


def _glued(text: str, at: int) -> bool:
    """Whether no cut may come before text[at]."""
    c = text[at]
    return bool(unicodedata.combining(c)) or unicodedata.category(c) in ("Mn", "Mc", "Me") or c in "‍️" or text[at - 1] == "‍"


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces of a text, as slices that overlap."""
    if len(text) <= limit:
        return [(0, len(text))]
    room = limit - overlap
    cuts = {m.end(): _STRENGTH[m.lastgroup] for m in _BOUNDARY.finditer(text)}
    places = sorted(cuts)

    def cut(a: int, b: int) -> int:
        mid, quarter = (a + b) // 2, max(1, (b - a) // 4)
        for lo, hi in ((mid - quarter, mid + quarter), (a + 1, b - 1)):
            lo, hi = max(lo, a + 1), min(hi, b - 1)
            near = places[bisect_left(places, lo) : bisect_left(places, hi + 1)]
            if near:
                return max(near, key=lambda p: (cuts[p], -abs(p - mid)))
        at = mid
        while at > a + 1 and _glued(text, at):
            at -= 1
        return at if at > a + 1 or not _glued(text, at) else mid

    out: list[tuple[int, int]] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            out.append((a, b))
        else:
            at = cut(a, b)
            todo += [(at, b), (a, at)]
    pieces = []
    for i, (a, b) in enumerate(out):
        start = a
        if i and overlap:
            start = max(0, a - overlap)
            words = places[bisect_left(places, start) : bisect_left(places, a)]
            if words:
                start = words[0]
            else:
                while start < a and _glued(text, start):
                    start += 1
        pieces.append((start, b))
    return pieces


def split_oversized(df: DataFrame, text: str = "chunk_text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Each row once for each piece, with text replaced by the piece, token_count its own, and piece_index, piece_count, piece_start (1-based).

    A column of the input that is named like one of the new ones is replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    new = ["token_count", "piece_index", "piece_count", "piece_start"]
    keep = [c for c in df.columns if c not in (text, *new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, out, count, index, pieces, start = [], [], [], [], [], []
            for i, raw in enumerate(b.column(len(keep)).to_pylist()):
                if raw is None:
                    cut, lead, body = [(0, 0)], 0, None
                else:
                    body = raw.strip(WHITE_SPACE)
                    lead = len(raw) - len(raw.lstrip(WHITE_SPACE))
                    cut = spans(body, limit, overlap)
                for k, (x, y) in enumerate(cut):
                    piece = None if body is None else body[x:y].rstrip(WHITE_SPACE)
                    take.append(i)
                    out.append(piece)
                    count.append(len(piece.split()) if piece else 0)
                    index.append(k)
                    pieces.append(len(cut))
                    start.append(lead + x + 1)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j).take(rows) for j in range(len(keep))), pa.array(out, pa.string()), *(pa.array(x, pa.int32()) for x in (count, index, pieces, start))],
                [*keep, text, *new],
            )

    schema = df.select(*keep).schema
    schema = T.StructType([*schema.fields, T.StructField(text, T.StringType()), *(T.StructField(c, T.IntegerType()) for c in new)])
    return df.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)


def oversized(df: DataFrame, text: str = "chunk_text", limit: int = LIMIT) -> DataFrame:
    """The rows that may exceed the limit; outer white space, which doesn't count, is judged by split_oversized."""
    return df.filter(F.length(F.col(text)) > limit)


def repaired_pages(chunks: DataFrame) -> DataFrame:
    """chunks with page_number taken from the neighbouring chunks of the document where it is null or below 1.

    The joins are on document and chunk index, so a document of any size spreads over all tasks.
    """
    page = F.when(F.col("page_number") >= 1, F.col("page_number"))
    known = chunks.groupBy("document_id", "chunk_index").agg(F.min(page).alias("_page")).filter("_page IS NOT NULL")
    before = known.select("document_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("_page").alias("_before"))
    after = known.select("document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("_page").alias("_after"))
    bad = chunks.filter("page_number IS NULL OR page_number < 1")
    fixed = (
        bad.join(before, ["document_id", "chunk_index"], "left")
        .join(after, ["document_id", "chunk_index"], "left")
        .withColumn("page_number", F.coalesce("_before", "_after").cast(chunks.schema["page_number"].dataType))
        .select(*chunks.columns)
    )
    return chunks.filter("page_number >= 1").unionByName(fixed)


#: Chunk indexes in a range of filled_pages; known pages judged together, and those of the neighbours that judge with them.
INDEXES_TOGETHER, PAGES_TOGETHER, PAGES_BESIDE = 1024, 256, 64


def out_of_order(pages: list[int]) -> list[int]:
    """The fewest places without which pages doesn't decrease; of equal choices the earlier page stays."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pages)
    for i in range(len(pages) - 1, -1, -1):
        at = bisect_right(tails, -pages[i])
        before[i] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [-pages[i]], [i]
    kept = set()
    i = ends[-1] if ends else -1
    while i >= 0:
        kept.add(i)
        i = before[i]
    return [i for i in range(len(pages)) if i not in kept]


def filled_pages(chunks: DataFrame) -> DataFrame:
    """(id, page_number) of chunks with unique id: pages that are missing, below 1 or break the order of the document's pages come from the nearest right page before, else after.

    Chunk indexes are cut into ranges, and what lies before and after a range is carried from range to
    range; so a document of any size is spread over many tasks. Pages are judged PAGES_TOGETHER at a
    time with PAGES_BESIDE on either side. A chunk without document or index keeps its page.
    """
    kind = chunks.schema["page_number"].dataType
    page = F.when(F.col("page_number") >= 1, F.col("page_number").cast("long"))
    rows = chunks.select("id", "document_id", "chunk_index", page.alias("_page"))
    placed = F.col("document_id").isNotNull() & F.col("chunk_index").isNotNull()
    apart = rows.filter(~placed).select("id", F.col("_page").cast(kind).alias("page_number"))
    rows = rows.filter(placed).withColumn("_part", F.expr(f"chunk_index DIV {INDEXES_TOGETHER}"))
    parts = Window.partitionBy("document_id").orderBy("_part")
    inner = Window.partitionBy("document_id", "_part").orderBy("chunk_index", F.col("_page").asc_nulls_last(), "id")
    back = Window.partitionBy("document_id", "_part").orderBy(F.col("chunk_index").desc(), F.col("_page").desc_nulls_first(), F.col("id").desc())

    # places of the known pages in their document, without gaps
    known = rows.filter("_page IS NOT NULL")
    counts = known.groupBy("document_id", "_part").agg(F.count("*").alias("_n"))
    counts = counts.select("document_id", "_part", (F.sum("_n").over(parts) - F.col("_n")).alias("_first"))
    at = known.withColumn("_at", F.row_number().over(inner)).join(counts, ["document_id", "_part"]).withColumn("_at", F.col("_at") + F.col("_first") - 1)
    sides = F.array_distinct(F.array(*(F.floor((F.col("_at") + x) / PAGES_TOGETHER) for x in (-PAGES_BESIDE, 0, PAGES_BESIDE))))
    groups = at.select("document_id", F.explode(sides).alias("_group"), F.struct("_at", "_page", "id").alias("_x")).filter("_group >= 0")
    groups = groups.groupBy("document_id", "_group").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    falls = F.exists(F.arrays_zip(F.col("_xs._page").alias("a"), F.slice("_xs._page", F.lit(2), F.size("_xs")).alias("b")), lambda x: x["a"] > x["b"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wrong = []
            for group, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wrong += [xs[i]["id"] for i in out_of_order([x["_page"] for x in xs]) if xs[i]["_at"] // PAGES_TOGETHER == group]
            yield pa.RecordBatch.from_arrays([pa.array(wrong, b.schema.field(1).type.value_type.field("id").type)], ["id"])

    wrong = groups.filter(falls).select("_group", "_xs").mapInArrow(judge, T.StructType([T.StructField("id", rows.schema["id"].dataType)]))

    right = rows.join(wrong.withColumn("_wrong", F.lit(True)), "id", "left").withColumn("_right", F.when(F.col("_wrong").isNull(), F.col("_page")))
    order = F.struct("chunk_index", "_page", "id")
    ends = right.groupBy("document_id", "_part").agg(
        F.min_by("_right", F.when(F.col("_right").isNotNull(), order)).alias("_head"), F.max_by("_right", F.when(F.col("_right").isNotNull(), order)).alias("_tail")
    )
    carried = ends.select(
        "document_id",
        "_part",
        F.last("_tail", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_head", ignorenulls=True).over(Window.partitionBy("document_id").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    near = right.withColumn("_up", F.last("_right", ignorenulls=True).over(inner)).withColumn("_down", F.last("_right", ignorenulls=True).over(back))
    filled = near.join(carried, ["document_id", "_part"]).select("id", F.coalesce("_right", "_up", "_before", "_down", "_after").cast(kind).alias("page_number"))
    return filled.unionByName(apart)
