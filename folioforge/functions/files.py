"""File functions as column expressions: digests, names, checks, folders, image thresholds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.textops import ascii_fold

# First bytes of the accepted kinds of file.
MAGIC = {"pdf": ["25504446"], "png": ["89504E470D0A1A0A"], "jpg": ["FFD8FF"], "jpeg": ["FFD8FF"], "tiff": ["49492A00", "4D4D002A"], "bmp": ["424D"]}
# Folder of each document type.
FOLDERS = {"Invoice": "invoices", "Receipt": "invoices", "Resume": "resumes", "Contract": "contracts"}
MAX_BYTES = 25 * 1024 * 1024


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def extension(name: Column) -> Column:
    """The extension in small letters without its point; '' where there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def safe_name(name: Column, fold: bool = True) -> Column:
    """A file name without folders and special characters; 'document' where nothing is left."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    ext = extension(base)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    stem = ascii_fold(stem) if fold else stem
    stem = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_\-.]", "_"), r"_+", "_")
    stem = F.regexp_replace(stem, r"^[._]+|[._]+$", "")
    stem = F.when(stem == "", F.lit("document")).otherwise(stem)
    return F.when(ext == "", stem).otherwise(F.concat(stem, F.lit("."), ext))


def stored_name(name: Column, file_hash: Column, at: Column, fold: bool = True) -> Column:
    """Time, eight digits of the digest and the safe name."""
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), F.substring(file_hash, 1, 8), safe_name(name, fold))


def folder(document_type: Column) -> Column:
    found = F.lit("other")
    for kind, name in FOLDERS.items():
        found = F.when(document_type == kind, F.lit(name)).otherwise(found)
    return found


def mime_type(name: Column) -> Column:
    """PDF by the extension; whatever else is accepted counts as an image."""
    return F.when(extension(name) == "pdf", "application/pdf").otherwise("image/png")


#: The earlier stages: 20 MB, four kinds of file, no look at the content, the name checked first.
EARLIER_LIMIT, EARLIER_KINDS = 20 * 1024 * 1024, ["pdf", "png", "jpg", "jpeg"]


def upload_error_by_name(name: Column, content: Column, limit: int = EARLIER_LIMIT, kinds: list[str] | None = None) -> Column:
    """The first reason of the earlier stages: NO_NAME, UNSUPPORTED, EMPTY or TOO_LARGE; null where a file is accepted."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    return F.when(blank, "NO_NAME").when(~extension(name).isin(kinds or EARLIER_KINDS), "UNSUPPORTED").when(size == 0, "EMPTY").when(size > limit, "TOO_LARGE")


def upload_error(name: Column, content: Column, limit: int = MAX_BYTES) -> Column:
    """The first reason to refuse a file: EMPTY, TOO_LARGE, UNSUPPORTED or BAD_CONTENT; null where it is accepted."""
    ext = extension(name)
    good = F.lit(False)
    for kind, starts in MAGIC.items():
        for m in starts:
            good = good | ((ext == kind) & (F.hex(F.substring(content, 1, len(m) // 2)) == m))
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size == 0, "EMPTY").when(size > limit, "TOO_LARGE").when(~ext.isin(list(MAGIC)), "UNSUPPORTED").when(~F.coalesce(good, F.lit(False)), "BAD_CONTENT")


def safe_path(path: Column, root: str) -> Column:
    """Whether a path stays in a folder."""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def otsu(histogram: np.ndarray) -> int:
    """The grey level that parts a histogram of 256 levels with the greatest variance between the two sides."""
    h = np.asarray(histogram, float)
    total = h.sum()
    if not total:
        return 0
    below = np.cumsum(h)
    above = total - below
    moment = np.cumsum(h * np.arange(len(h)))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (moment / below - (moment[-1] - moment) / above) ** 2
    between = np.nan_to_num(between)
    return int(np.argmax(between))


def scaled(grey: np.ndarray, by: float) -> np.ndarray:
    """A grey image enlarged by a factor, between the nearest pixels by their distance."""
    a = np.asarray(grey, float)
    if by == 1 or not a.size:
        return a
    h, w = (max(1, round(n * by)) for n in a.shape)
    y, x = (np.clip((np.arange(m) + 0.5) / by - 0.5, 0, n - 1) for m, n in ((h, a.shape[0]), (w, a.shape[1])))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def binarised(grey: np.ndarray, contrast: float = 2.0, scale: float = 1.0) -> np.ndarray:
    """A grey image, enlarged, with its contrast raised, median-filtered and parted at its Otsu level into 0 and 255."""
    a = scaled(grey, scale)
    a = np.clip((a - a.mean()) * contrast + a.mean(), 0, 255)
    p = np.pad(a, 1, mode="edge")
    a = np.median(np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)]), axis=0)
    level = otsu(np.bincount(a.astype(np.uint8).ravel(), minlength=256))
    return np.where(a > level, 255, 0).astype(np.uint8)


def grey_of(content: bytes | None) -> np.ndarray | None:
    """The grey levels of a binary PGM or PPM image; None for other bytes, which need a decoder of their own."""
    if not content or content[:2] not in (b"P5", b"P6"):
        return None
    header = re.match(rb"P[56](?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", content)
    if not header or int(header[3]) > 255:
        return None
    w, h, depth = int(header[1]), int(header[2]), 1 if content[:2] == b"P5" else 3
    body = np.frombuffer(content[header.end() :], np.uint8)
    if len(body) < w * h * depth:
        return None
    a = body[: w * h * depth].reshape(h, w, depth).astype(float)
    return a[:, :, 0] if depth == 1 else a @ np.array([0.299, 0.587, 0.114])


def prepared_images(df: DataFrame, content: str = "content", decode: Callable[[bytes], np.ndarray | None] = grey_of, contrast: float = 2.0, scale: float = 1.0) -> DataFrame:
    """df with prepared_image, the image made ready for recognition as a binary PGM; null where decode gives nothing or fails.

    The final stage takes contrast 2, the earlier ones contrast 1.8 and scale 1.5.
    """

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for b in s:
                try:
                    grey = None if b is None else decode(bytes(b))
                except Exception:
                    grey = None
                if grey is None:
                    out.append(None)
                else:
                    a = binarised(grey, contrast, scale)
                    out.append(b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.tobytes())
            yield pd.Series(out, dtype=object)

    return df.withColumn("prepared_image", run(F.col(content)))
